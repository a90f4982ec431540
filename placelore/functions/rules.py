"""Rule tables. Every table is a default argument somewhere; pass your own to change the rules."""

# ---------------------------------------------------------------------------
# Labels, patterns and cut-offs that must be these for equal results.
# ---------------------------------------------------------------------------

TIME_OF_DAY = [
    ("EVENING", [r"\bevening\b", r"\bdusk\b", r"\bsunset\b", r"\bnightfall\b",
                 r"after \d{1,2}\s*(?:pm|o'?clock)", r"\b(?:5|6|7)\s*pm\b"]),
    ("EARLY_MORNING", [r"early (?:in the )?mornings?", r"\bsunrise\b", r"\bsun rise\b", r"\bdawn\b",
                       r"\bdaybreak\b", r"\bbreak of day\b", r"first thing",
                       r"before (?:9|8|7|6|nine|eight|seven|six)\b",
                       r"\b(?:1|2|3|4|5|6|7|8)\s*am\b", r"\b(?:4|5|6)\s*o'?clock\b",
                       r"early part of (?:the )?day", r"earlier in the day", r"\bearly hours?\b",
                       r"(?:go|climb|visit|arrive|start|leave|set off|come|walk|went|hike|reach|get there)"
                       r"\s+\w{0,8}?\s*earl(?:y|ier)",
                       r"\bearlier\b"]),
    ("MID_MORNING", [r"mid[- ]?morning", r"\bmorning\b", r"\b(?:9|10|11)\s*am\b"]),
    ("AFTERNOON", [r"\bafternoon\b", r"\bmidday\b", r"\bmid[- ]?day\b", r"\bnoon\b", r"\b(?:12|1|2|3)\s*pm\b"]),
    ("NIGHT", [r"\bnight\b", r"after dark", r"night ?time", r"\b(?:8|9|10|11)\s*pm\b"]),
]
TIME_PREFERENCE = ["EARLY_MORNING", "MID_MORNING", "EVENING", "AFTERNOON", "NIGHT"]
TIME_NEGATION = (r"\b(?:not|never|avoid|avoiding|don'?t|do not|rather than|apart from|"
                 r"other than|except|skip|stay away|steer clear|no need)\b")
HEAT = r"\b(?:hot|heat|humid|sun|sunny|warm)\b"

SEASON = [
    ("DRY_SEASON", [r"\bdry season\b", r"\bdry months?\b", r"\b(december|january|february|march|april)\b",
                    r"\bnorth[- ]?east monsoon\b"]),
    ("MONSOON", [r"\b(monsoon|rainy season|wet season)\b", r"\b(may|june|july|august|september|october)\b",
                 r"\bsouth[- ]?west monsoon\b"]),
    ("SHOULDER", [r"\b(november|shoulder season)\b"]),
]
MONTHS = ["january", "february", "march", "april", "may", "june",
          "july", "august", "september", "october", "november", "december"]

DAY_TYPE = [
    ("WEEKEND", [r"\bweekend(s)?\b"]),
    ("WEEKDAY", [r"\bweekday(s)?\b", r"\bweek day(s)?\b"]),
    ("PUBLIC_HOLIDAY", [r"\b(public holiday|poya day|poya|full moon poya|national holiday|bank holiday)\b"]),
]
DAY_AVOID = r"\b(?:avoid|avoiding|not|never|don'?t|do not|skip|stay away|steer clear|rather than|worst)\w*\b"
HOLIDAY = r"\b(?:public holiday|poya|full moon|national holiday|bank holiday)"

CROWD_LEVELS = [
    (5, [r"\b(very |extremely |super |incredibly |absolutely )?(over ?crowded|crowded|packed|jam[- ]?packed|overrun|swarming)\b",
         r"\bimpossible to (enjoy|move|visit)\b", r"\boverwhelming (crowd|number of tourist|tourist)\b",
         r"\b(too much|so much|way too much) (of a )?crowd"]),
    (4, [r"\b(crowded|busy|full of (tourist|people|visitor)|lot of (tourist|people))\b",
         r"\bmany (tourist|people|visitor|crowd)\b",
         r"\b(lots?|loads|plenty|a lot) of (crowd|people|tourist|visitor)",
         r"\bquite (some|a few|a lot of) (people|crowd|tourist)", r"\blong queue\b", r"\blong wait\b"]),
    (3, [r"\b(moderate|manageable|some tourist|somewhat busy|a (few|bit) crowd)\b",
         r"\bnot too (crowded|busy)\b"]),
    (2, [r"\b(quiet|calm|peaceful|not (very |too )?crowd|not (very |too )?busy|less crowd|fewer (tourist|people))\b",
         r"\bnot (many|much) (tourist|people|crowd|visitor)\b"]),
    (1, [r"\b(empty|deserted|no one|nobody|to ourselves|had (the place|it) (all )?to (our|my)self)\b",
         r"\bno other (people|visitor|tourist)\b", r"\bno (queue|wait|crowd)\b"]),
]
CROWD_LABEL = {1: "EMPTY", 2: "QUIET", 3: "MODERATE", 4: "BUSY", 5: "PACKED"}
CROWD_NEGATION = (r"\b(?:not|never|hardly|barely|isn'?t|wasn'?t|weren'?t|aren'?t|no)\b"
                  r"(?:\s+\w+){0,3}\s+(?:crowd|crowded|busy|packed|overrun|overcrowded|touristy|full)")

AMOUNT = (r"(?:rs\.?\s*|lkr\s*|rupees?\s*)(\d[\d,]*)"
          r"|(\d[\d,]*)\s*(?:rs\.?|lkr|rupees?)"
          r"|(?:us\$\s*|\$\s*)(\d[\d,.]*)"
          r"|(\d[\d,.]*)\s*(?:usd|us dollars?|dollars?)")
AMOUNT_FOREIGN = r"foreign|tourist|non[- ]?local"
AMOUNT_LOCAL = r"\blocal|resident|sri[- ]?lankan|citizen"
AMOUNT_CONTEXT = (18, 22)
USD_TO_LKR = 300
COST_CUTOFFS = (500, 1500, 5000)

COST_OPINION = [
    ("FREE", [r"\bfree\b", r"\bno (entry |admission |entrance )?fee\b", r"\bno charge\b", r"\bfree of charge\b"]),
    ("VERY_HIGH", [r"\bvery expensive\b", r"\boverpriced\b", r"\bway too (high|much|expensive)\b"]),
    ("HIGH", [r"\bexpensive\b", r"\bpricey\b", r"\btoo (high|much|expensive)\b",
              r"\bnot (cheap|affordable|worth)\b"]),
    ("MODERATE", [r"\breasonable\b", r"\baffordable\b", r"\bworth (it|the|every)\b",
                  r"\bnot (expensive|pricey|too much)\b"]),
    ("LOW", [r"\bcheap\b", r"\binexpensive\b", r"\bvery affordable\b", r"\bgreat value\b",
             r"\bvalue for money\b", r"\bnot much\b", r"\bnot a lot\b", r"\bnominal\b", r"\bminimal\b",
             r"\b(small|little|tiny) (fee|charge|amount|entrance fee|entry fee)\b"]),
]
FEE_WORDS = [
    ("CONSERVATION_FEE", ["conservation fee", "park fee", "wildlife"]),
    ("ENTRY_FEE", ["entry fee", "entrance fee", "admission", "gate fee", "ticket price", "ticket cost"]),
]
EVALUATION_WORDS = {"free": "free", "cheap": "cheap", "inexpensive": "cheap", "affordable": "affordable",
                    "reasonable": "reasonable", "expensive": "expensive", "pricey": "expensive",
                    "overpriced": "overpriced", "worth": "worth_it"}

SPAN_PHRASES = {
    "best_time": ["early morning", "early in the morning", "early in morning", "in the morning",
                  "morning hours", "mid morning", "late morning", "in the afternoon", "mid day", "midday",
                  "noon", "in the evening", "late afternoon", "at sunset", "at sunrise", "at night",
                  "after dark", "rainy season", "dry season", "monsoon season", "peak season", "off season",
                  "off-season", "shoulder season", "dry months", "wet months", "weekday", "weekdays",
                  "weekend", "weekends", "public holiday", "public holidays", "poya day"],
    "crowd_level": ["very crowded", "extremely crowded", "too crowded", "quite crowded", "not crowded",
                    "less crowded", "not too crowded", "very busy", "extremely busy", "not busy", "less busy",
                    "packed with tourists", "packed with people", "full of tourists", "full of people",
                    "lots of tourists", "lot of tourists", "many tourists", "few visitors", "few people",
                    "no one", "no other people", "had the place to ourselves", "had it to ourselves",
                    "long queue", "long queues", "long wait", "overrun with tourists"],
    "cost_level": ["entry fee", "entrance fee", "admission fee", "gate fee", "conservation fee", "park fee",
                   "ticket price", "free entry", "free admission", "free of charge", "no entry fee",
                   "no charge", "no admission fee", "value for money", "worth it", "worth every rupee"],
}

TAG_KEYWORDS = {
    "best_time": ["morning", "afternoon", "evening", "night", "sunrise", "sunset", "dawn", "dusk", "midday",
                  "noon", "dry season", "monsoon", "rainy", "wet season", "shoulder season", "weekday",
                  "weekend", "holiday", "poya", "early", "am", "pm", "o'clock", "peak season",
                  "off season"] + MONTHS,
    "crowd_level": ["crowd", "crowded", "packed", "busy", "quiet", "calm", "peaceful", "empty", "deserted",
                    "queue", "queues", "tourist", "tourists", "people", "overcrowded", "overrun",
                    "swarming", "rush", "jam", "solitude"],
    "cost_level": ["fee", "price", "priced", "ticket", "cost", "costs", "rupee", "rupees", "rs", "lkr",
                   "dollar", "dollars", "usd", "free", "expensive", "cheap", "affordable", "admission",
                   "charge", "entry", "entrance", "pricey", "value", "conservation fee"],
}
TAG_THRESHOLDS = {"best_time": 0.34, "crowd_level": 0.34, "cost_level": 0.30}
CATEGORIES = ["best_time", "crowd_level", "cost_level"]

POSITIVE_WORDS = (
    "amazing awesome beautiful best excellent great good fantastic wonderful lovely nice perfect enjoyable enjoyed "
    "recommend recommended worth worthwhile stunning spectacular breathtaking memorable incredible impressive "
    "interesting pleasant peaceful relaxing calm serene safe clear clean fun exciting authentic informative friendly "
    "magnificent gorgeous superb magical cool mesmerizing unforgettable scenic picturesque").split()
NEGATIVE_WORDS = (
    "bad terrible awful poor disappointing disappointed dangerous unsafe risky crowded overcrowded dirty polluted "
    "boring expensive overpriced waste difficult hard tough tiring exhausting slippery steep closed unavailable worst "
    "hassle noisy rough scam unpleasant avoid annoying harassment extortionate dubious problem problems").split()
POSITIVE_PHRASES = ["highly recommend", "must visit", "worth a visit", "worth visiting", "well worth", "good for",
                    "great for", "perfect for", "best place", "loved", "enjoyed"]
NEGATIVE_PHRASES = ["not worth", "not recommend", "would not recommend", "too crowded", "too expensive",
                    "too difficult", "not safe", "not allowed", "couldn't", "could not", "unable to", "waste of",
                    "dangerous", "unsafe"]
NEGATORS = ["not", "no", "never", "without", "hardly"]

# (activity, keywords, patterns)
ACTIVITY_RULES = [
    ("White water rafting", ["white water", "white-water"], [r"\bwhite[-\s]?water\s+rafting\b"]),
    ("Rafting", ["raft"], [r"\braft(?:ing|ed)?\b"]),
    ("Scuba diving", ["scuba"], [r"\bscuba\s+div(?:e|ing|ed)?\b"]),
    ("Diving", ["dive", "diving", "dived"], [r"\bdiv(?:e|ing|ed|es)\b"]),
    ("Sea bathing", ["sea bath", "bathing"], [r"\bsea\s+bath(?:ing)?\b", r"\bbath(?:e|ing|ed)?\s+in\s+the\s+sea\b"]),
    ("Swimming", ["swim", "swam", "dip"], [r"\bswim(?:ming|s|med)?\b", r"\bswam\b", r"\btake\s+a\s+dip\b"]),
    ("Kite surfing", ["kite", "kitesurf"], [r"\bkite[-\s]?surf(?:ing|ed)?\b", r"\bkitesurf(?:ing|ed)?\b"]),
    ("Wind surfing", ["wind surf", "windsurf"], [r"\bwind[-\s]?surf(?:ing|ed)?\b", r"\bwindsurf(?:ing|ed)?\b"]),
    ("Surfing", ["surf"], [r"\bsurf(?:ing|ed)?\b", r"\bsurf\s+lessons?\b"]),
    ("Body boarding", ["body board", "bodyboard"], [r"\bbody[-\s]?boarding\b", r"\bbody\s+board(?:ing)?\b"]),
    ("Paddle boarding", ["paddle", "sup"], [r"\bpaddle[-\s]?boarding\b", r"\bstand[-\s]?up\s+paddle(?:\s+board(?:ing)?)?\b", r"\bSUP\b"]),
    ("Snorkelling", ["snorkel"], [r"\bsnorkel(?:ling|ing|ed)?\b", r"\bsnorkels?\b"]),
    ("Sunbathing", ["sunbath", "tan", "lie in the sun"], [r"\bsunbath(?:e|ing|ed)?\b", r"\btan(?:ning|ned)?\b", r"\blie\s+in\s+the\s+sun\b"]),
    ("Beach walking", ["beach", "stroll"], [r"\bwalk(?:ed|ing)?\s+(?:along|on|by|down|around)\s+(?:the\s+)?beach\b", r"\bbeach\s+walk(?:ing)?\b", r"\bstroll(?:ed|ing)?\s+(?:along|on)\s+(?:the\s+)?beach\b"]),
    ("Beach relaxing", ["beach", "relax", "chill"], [r"\brelax(?:ed|ing)?\s+(?:on|at|by)\s+(?:the\s+)?beach\b", r"\bbeach\s+relax(?:ing|ation)?\b", r"\bchill(?:ed|ing)?\s+(?:on|at|by)\s+(?:the\s+)?beach\b"]),
    ("Lagoon visit", ["lagoon"], [r"\bvisit(?:ed|ing)?\s+(?:the\s+)?lagoon\b", r"\blagoon\s+(?:visit|tour|trip)\b", r"\b(?:in|around)\s+(?:the\s+)?lagoon\b"]),
    ("Boat safari", ["boat safari", "safari boat"], [r"\bboat\s+safari\b", r"\bsafari\s+boat\b"]),
    ("Boat ride", ["boat", "cruise"], [r"\bboat\s+(?:ride|trip|tour|cruise|journey)\b", r"\btook\s+(?:a\s+)?boat\b", r"\bby\s+boat\b", r"\bboating\b", r"\bcruise\b"]),
    ("Canoeing", ["canoe"], [r"\bcanoe(?:ing|d)?\b"]),
    ("Kayaking", ["kayak"], [r"\bkayak(?:ing|ed)?\b"]),
    ("Waterfall bathing", ["waterfall", "falls"], [r"\bbath(?:e|ing|ed)?\s+(?:at|in|under)\s+(?:the\s+)?waterfalls?\b", r"\bswim(?:ming)?\s+(?:at|in|under)\s+(?:the\s+)?waterfalls?\b"]),
    ("Waterfall visit", ["waterfall", "falls"], [r"\bvisit(?:ed|ing)?\s+(?:the\s+)?(?:[\w'’.-]+\s+)?waterfalls?\b", r"\bwaterfalls?\s+(?:visit|trip|tour)\b", r"\bwent\s+to\s+(?:the\s+)?waterfalls?\b", r"\bsee\s+(?:the\s+)?waterfalls?\b"]),
    ("Fishing", ["fishing", "fished", "fish trip"], [r"\bfishing\b", r"\bfished\b", r"\bgo(?:ing)?\s+fishing\b", r"\bfish(?:ing)?\s+(?:trip|tour)\b"]),
    ("Mountain biking", ["mountain bik"], [r"\bmountain\s+bik(?:e|ing|ed)\b"]),
    ("Cycling", ["cycl", "bike", "biking"], [r"\bcycl(?:e|ing|ed)\b", r"\bbike\s+ride\b", r"\bbiking\b"]),
    ("Rock climbing", ["rock climb"], [r"\brock\s+climb(?:ing|ed)?\b"]),
    ("Mountain climbing", ["mountain", "climb"], [r"\bmountain\s+climb(?:ing|ed)?\b", r"\bclimb(?:ed|ing)?\s+(?:up\s+)?(?:the\s+)?mountain\b"]),
    ("Hiking", ["hike", "hiking", "hiked"], [r"\bhik(?:e|ing|ed|es)\b"]),
    ("Trekking", ["trek"], [r"\btrek(?:king|ked|s)?\b"]),
    ("Nature walk", ["nature walk"], [r"\bnature\s+walk(?:ing)?\b"]),
    ("Walking trail", ["trail"], [r"\bwalking\s+trail\b", r"\btrail\s+walk(?:ing)?\b", r"\bwalk(?:ed|ing)?\s+(?:the\s+)?trail\b"]),
    ("Ziplining", ["zip"], [r"\bzip[-\s]?lin(?:e|ing|ed)\b"]),
    ("Abseiling", ["abseil", "rappel"], [r"\babseil(?:ing|ed)?\b", r"\brappel(?:ling|ing|ed)?\b"]),
    ("Camping", ["camp"], [r"\bcamp(?:ing|ed)?\b", r"\bcamp\s+site\b"]),
    ("Caving", ["cave", "caving"], [r"\bcaving\b", r"\bcave\s+explor(?:e|ing|ation)\b"]),
    ("Forest walk", ["forest", "rainforest"], [r"\bforest\s+walk(?:ing)?\b", r"\bwalk(?:ed|ing)?\s+(?:through|in|inside)\s+(?:the\s+)?(?:rain\s*)?forest\b"]),
    ("Jeep safari", ["jeep", "4x4"], [r"\bjeep\s+safari\b", r"\bsafari\s+jeep\b", r"\b4x4\s+safari\b"]),
    ("Safari", ["safari", "game drive"], [r"\bsafari(?:s)?\b", r"\bgame\s+drive\b"]),
    ("Whale watching", ["whale"], [r"\bwhale\s*watch(?:ing)?\b", r"\bwatch(?:ed|ing)?\s+whales\b", r"\bsee\s+whales\b", r"\bsaw\s+whales\b"]),
    ("Dolphin watching", ["dolphin"], [r"\bdolphin\s*watch(?:ing)?\b", r"\bwatch(?:ed|ing)?\s+dolphins\b", r"\bsee\s+dolphins\b", r"\bsaw\s+dolphins\b"]),
    ("Elephant watching", ["elephant"], [r"\belephant\s*watch(?:ing)?\b", r"\bwatch(?:ed|ing)?\s+elephants\b", r"\bsee\s+elephants\b", r"\bsaw\s+elephants\b", r"\belephants?\s+(?:watching|seen|spotting)\b"]),
    ("Leopard watching", ["leopard"], [r"\bleopard\s*watch(?:ing)?\b", r"\bwatch(?:ed|ing)?\s+leopards\b", r"\bsee\s+leopards\b", r"\bsaw\s+leopards\b", r"\bleopards?\s+(?:watching|seen|spotting)\b"]),
    ("Turtle watching", ["turtle"], [r"\bturtle\s*watch(?:ing)?\b", r"\bwatch(?:ed|ing)?\s+turtles\b", r"\bsee\s+turtles\b", r"\bsaw\s+turtles\b", r"\bturtles?\s+(?:watching|seen|spotting)\b"]),
    ("Bird watching", ["bird"], [r"\bbird\s*watch(?:ing)?\b", r"\bwatch(?:ed|ing)?\s+birds\b", r"\bbird\s+spotting\b", r"\bsaw\s+birds\b"]),
    ("Wildlife watching", ["wildlife", "animal", "spotting"], [r"\bwildlife\s*watch(?:ing)?\b", r"\bwatch(?:ed|ing)?\s+wildlife\b", r"\bsee\s+wildlife\b", r"\bsaw\s+wildlife\b", r"\banimal\s+spotting\b", r"\bspot(?:ted|ting)?\s+(?:wildlife|animals)\b"]),
    ("Scenic train ride", ["train", "scenic"], [r"\bscenic\s+train\s+(?:ride|journey|trip)\b", r"\btrain\s+(?:ride|journey|trip).{0,50}\bscenic\b", r"\bscenic.{0,50}\btrain\b"]),
    ("Train ride", ["train"], [r"\btrain\s+(?:ride|journey|trip)\b", r"\btook\s+(?:the\s+)?train\b", r"\bby\s+train\b"]),
    ("Scenic drive", ["drive", "scenic"], [r"\bscenic\s+drive\b", r"\bdrive\s+(?:was\s+)?scenic\b", r"\bdrive\s+(?:through|around|along)\b"]),
    ("Sunset watching", ["sunset"], [r"\bsunset(?:s)?\b", r"\bwatch(?:ed|ing)?\s+(?:the\s+)?sunset\b"]),
    ("Sunrise watching", ["sunrise"], [r"\bsunrise(?:s)?\b", r"\bwatch(?:ed|ing)?\s+(?:the\s+)?sunrise\b"]),
    ("Viewpoint visit", ["viewpoint", "view point", "lookout", "observation"], [r"\bviewpoint\b", r"\bview\s+point\b", r"\blookout\b", r"\bobservation\s+(?:deck|point)\b"]),
    ("Photography", ["photo", "picture", "photograph"], [r"\bphotograph(?:y|s|ed|ing)?\b", r"\bphotos?\b", r"\bpictures?\b", r"\btake\s+(?:some\s+)?(?:photos|pictures)\b", r"\bphoto\s+op(?:portunity)?\b"]),
    ("Sightseeing", ["sightseeing", "sight-seeing", "sights"], [r"\bsightseeing\b", r"\bsight[-\s]?seeing\b", r"\bsee\s+(?:the\s+)?sights\b"]),
    ("Temple visit", ["temple", "vihara", "viharaya", "kovil"], [r"\bvisit(?:ed|ing)?\s+(?:the\s+)?(?:[\w'’.-]+\s+)?(?:temple|vihara|viharaya|kovil)\b", r"\btemple\s+visit\b", r"\bwent\s+to\s+(?:the\s+)?(?:[\w'’.-]+\s+)?temple\b"]),
    ("Pilgrimage", ["pilgrim"], [r"\bpilgrimage\b", r"\bpilgrims?\b"]),
    ("Religious visit", ["church", "mosque", "shrine", "dagoba", "stupa", "buddha"], [r"\breligious\s+visit\b", r"\bvisit(?:ed|ing)?\s+(?:the\s+)?(?:church|mosque|kovil|shrine|dagoba|stupa|buddha\s+statue)\b"]),
    ("Ancient city visit", ["ancient city"], [r"\bancient\s+city\s+(?:visit|tour)\b", r"\bvisit(?:ed|ing)?\s+(?:the\s+)?ancient\s+city\b"]),
    ("Ruins exploration", ["ruin", "ruins"], [r"\bruin(?:s)?\s+(?:exploration|tour|visit)\b", r"\bexplor(?:e|ed|ing)\s+(?:the\s+)?ruins\b", r"\bwalk(?:ed|ing)?\s+(?:through|around)\s+(?:the\s+)?ruins\b"]),
    ("Heritage exploration", ["heritage", "historical", "history"], [r"\bheritage\s+(?:exploration|tour|visit|site)\b", r"\bexplor(?:e|ed|ing)\s+(?:the\s+)?heritage\b", r"\bhistorical\s+(?:tour|visit|site)\b"]),
    ("Fort visit", ["fort"], [r"\bvisit(?:ed|ing)?\s+(?:the\s+)?(?:[\w'’.-]+\s+)?fort\b", r"\bfort\s+visit\b", r"\bwent\s+to\s+(?:the\s+)?(?:[\w'’.-]+\s+)?fort\b"]),
    ("Museum visit", ["museum"], [r"\bvisit(?:ed|ing)?\s+(?:the\s+)?(?:[\w'’.-]+\s+)?museum\b", r"\bmuseum\s+visit\b"]),
    ("Cultural show", ["cultural show", "dance show", "traditional show"], [r"\bcultural\s+show\b", r"\bdance\s+show\b", r"\btraditional\s+show\b"]),
    ("Village tour", ["village"], [r"\bvillage\s+(?:tour|walk|visit)\b", r"\bvisit(?:ed|ing)?\s+(?:a\s+)?village\b"]),
    ("Tea tasting", ["tea", "taste"], [r"\btea\s+tast(?:e|ing)\b", r"\btast(?:e|ed|ing)\s+(?:the\s+)?tea\b"]),
    ("Tea factory visit", ["tea factory"], [r"\btea\s+factory\s+(?:visit|tour)\b", r"\bvisit(?:ed|ing)?\s+(?:the\s+)?tea\s+factory\b"]),
    ("Tea plantation visit", ["tea plantation", "tea estate"], [r"\btea\s+plantation\s+(?:visit|tour)\b", r"\bvisit(?:ed|ing)?\s+(?:the\s+)?tea\s+(?:plantation|estate)\b", r"\bwalk(?:ed|ing)?\s+(?:through|around)\s+(?:the\s+)?tea\s+(?:plantation|estate)\b"]),
    ("Street food tasting", ["street food"], [r"\bstreet\s+food\b"]),
    ("Seafood tasting", ["seafood", "sea food"], [r"\bseafood\b", r"\bsea\s+food\b"]),
    ("Local food tasting", ["local food", "food tasting", "try food", "taste food"], [r"\blocal\s+food\b", r"\btast(?:e|ed|ing)\s+(?:the\s+)?(?:local\s+)?food\b", r"\btry\s+(?:the\s+)?(?:local\s+)?food\b", r"\bfood\s+tasting\b"]),
    ("Market visit", ["market"], [r"\bvisit(?:ed|ing)?\s+(?:the\s+)?(?:local\s+)?market\b", r"\bmarket\s+(?:visit|tour)\b", r"\bwalk(?:ed|ing)?\s+(?:through|around)\s+(?:the\s+)?market\b"]),
    ("Souvenir shopping", ["souvenir"], [r"\bsouvenir\s+shopping\b", r"\bbuy(?:ing|\s+some)?\s+souvenirs?\b", r"\bsouvenirs?\b"]),
    ("Shopping", ["shopping", "shop", "shops"], [r"\bshopping\b", r"\bshop(?:ped|ping)?\b", r"\bshops?\b"]),
    ("Cooking class", ["cooking class", "cookery"], [r"\bcooking\s+class\b", r"\bcookery\s+class\b"]),
    ("Ayurveda wellness", ["ayurveda", "ayurvedic"], [r"\bayurved(?:a|ic)\b"]),
    ("Spa treatment", ["spa", "massage"], [r"\bspa\b", r"\bmassage\b"]),
    ("Meditation", ["meditat"], [r"\bmeditat(?:e|ion|ing|ed)\b"]),
    ("Yoga", ["yoga"], [r"\byoga\b"]),
    ("Picnic", ["picnic"], [r"\bpicnic\b"]),
    ("Relaxing", ["relax", "chill", "unwind"], [r"\brelax(?:ing|ed|ation)?\b", r"\bchill(?:ed|ing)?\b", r"\bunwind\b"]),
]
SPECIFIC_SKIP = [("Diving", "scuba"), ("Rafting", "white water"), ("Rafting", "white-water"),
                 ("Surfing", "kitesurf"), ("Surfing", "kite surf"), ("Surfing", "windsurf"),
                 ("Surfing", "wind surf"), ("Boat ride", "boat safari"), ("Safari", "jeep safari"),
                 ("Safari", "4x4 safari"), ("Train ride", "scenic train"), ("Cycling", "mountain biking"),
                 ("Shopping", "souvenir"), ("Relaxing", "beach relaxing"), ("Shopping", "workshop")]
VISIT_ACTION = r"\b(visit(?:ed|ing)?|went|go(?:ing)?|tour(?:ed|ing)?|walk(?:ed|ing)?|explor(?:e|ed|ing)|see|saw|seen)\b"
IMPLIED_RULES = [
    ("Temple visit", r"\b(temple|vihara|viharaya|kovil)\b"),
    ("Religious visit", r"\b(church|mosque|shrine|dagoba|stupa|buddha|tooth\s+relic)\b"),
    ("Fort visit", r"\bfort\b"),
    ("Museum visit", r"\bmuseum\b"),
    ("Waterfall visit", r"\bfalls?|waterfall\b"),
    ("Ancient city visit", r"\bancient\s+city|polonnaruwa|anuradhapura\b"),
    ("Ruins exploration", r"\bruins?|archaeological\b"),
    ("Tea factory visit", r"\btea\s+factory\b"),
    ("Tea plantation visit", r"\btea\s+(plantation|estate)\b"),
]
GENERIC_ACTIVITIES = ["Sunset watching", "Sunrise watching", "Photography", "Relaxing"]

THEMES = [
    ("beach", ["beach", "lighthouse", "bay"]),
    ("heritage", ["religious", "heritage", "fort", "historic", "memorial", "cultural", "museum"]),
    ("wildlife", ["wildlife", "national park", "zoo", "bird", "forest", "wetland"]),
    ("water", ["waterfall", "lake", "river", "hot springs"]),
    ("views", ["viewpoint", "hiking", "natural landmark"]),
    ("parks", ["garden", "park", "promenade"]),
    ("city", ["shopping", "market", "tower", "landmark", "engineering", "hotel", "activity", "farm", "factory"]),
]
COST_TEXT = {"FREE": "Free", "LOW": "Budget", "MODERATE": "Moderate", "HIGH": "Premium", "VERY_HIGH": "Luxury"}
COST_PRICE = {"FREE": "Free", "LOW": "$", "MODERATE": "$$", "HIGH": "$$$", "VERY_HIGH": "$$$$"}
CROWD_TEXT = {"EMPTY": "Very quiet", "QUIET": "Quiet", "MODERATE": "Moderate", "BUSY": "Busy", "PACKED": "Packed"}

BAD_WEATHER_WORDS = ["rain", "thunderstorm", "storm", "flood", "drizzle", "heavy rain", "very heavy rain",
                     "extreme rain", "squall", "shower"]
BAD_WEATHER_MAIN = ["rain", "thunderstorm", "drizzle", "squall"]

CROWD_WORDS = {"empty": "EMPTY", "no one": "EMPTY", "deserted": "EMPTY", "quiet": "QUIET",
               "not crowded": "QUIET", "uncrowded": "QUIET", "less crowded": "QUIET", "not busy": "QUIET",
               "avoid crowds": "QUIET", "peaceful": "QUIET", "calm": "QUIET", "tranquil": "QUIET",
               "serene": "QUIET", "moderate": "MODERATE", "somewhat busy": "MODERATE", "busy": "BUSY",
               "crowded": "BUSY", "popular": "BUSY", "packed": "PACKED", "very crowded": "PACKED",
               "extremely crowded": "PACKED", "heaving": "PACKED"}
CROWD_RANGE = {"EMPTY": (1, 1), "QUIET": (1, 2), "MODERATE": (3, 3), "BUSY": (4, 4), "PACKED": (5, 5)}
TIME_WORDS = {"early morning": "EARLY_MORNING", "very early": "EARLY_MORNING", "dawn": "EARLY_MORNING",
              "sunrise": "EARLY_MORNING", "morning": "MID_MORNING", "mid morning": "MID_MORNING",
              "late morning": "MID_MORNING", "noon": "AFTERNOON", "afternoon": "AFTERNOON",
              "midday": "AFTERNOON", "lunch time": "AFTERNOON", "evening": "EVENING", "sunset": "EVENING",
              "dusk": "EVENING", "night": "NIGHT", "nighttime": "NIGHT", "after dark": "NIGHT"}
# Season and cost words are resolved to the values that profiles store, so lookups meet stored profiles.
SEASON_WORDS = {"dry season": "DRY_SEASON", "dry": "DRY_SEASON", "summer": "DRY_SEASON",
                "wet season": "MONSOON", "wet": "MONSOON", "monsoon": "MONSOON", "rainy": "MONSOON",
                "winter": "MONSOON"}
COST_WORDS = {"free": "FREE", "free entry": "FREE", "no fee": "FREE", "no cost": "FREE", "no charge": "FREE",
              "cheap": "LOW", "budget": "LOW", "affordable": "LOW", "inexpensive": "LOW", "low cost": "LOW",
              "moderate": "MODERATE", "reasonable": "MODERATE", "mid range": "MODERATE", "expensive": "HIGH",
              "pricey": "HIGH", "high cost": "HIGH", "luxury": "HIGH", "costly": "HIGH"}
QUIET_WORDS = ["not crowded", "uncrowded", "quiet", "peaceful", "avoid crowds", "less busy", "not busy",
               "empty", "serene", "tranquil"]
BUSY_WORDS = ["busy", "packed", "popular", "lively", "crowded", "vibrant"]
NEAR_WORDS = ["near", "nearby", "around", "closest", "surrounding"]
# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------
