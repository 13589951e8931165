"""Word lists, lookup tables and constants that results depend on.

Everything here is data. Changing a value changes which pages are trusted, how
a date is weighted or what counts as a price.
"""

# ---- fixed values: sheet headers (role -> header hints, in order of preference)
COLUMN_HINTS = {
    "name": ["building name", "project name", "society name", "property name", "building", "project", "society", "name", "complex", "apartment"],
    "locality": ["locality", "sub locality", "sublocality", "micro market", "neighbourhood", "neighborhood", "area", "location", "sector", "region"],
    "city": ["city", "town", "district"],
    "lat": ["latitude", "lat"],
    "lon": ["longitude", "lng", "lon", "long"],
    "rera": ["rera id", "reraid", "rera number", "rera no", "rera registration", "rera"],
    "existing": ["possession date", "possession", "completiondate", "completion date"],
    "min_price": ["longminprice", "min price", "minprice"],
    "max_price": ["longmaxprice", "max price", "maxprice"],
}
NULL_WORDS = ["nan", "none", "null", "-", "na", "n/a"]

# ---- fixed values: source trust
DOMAIN_WEIGHT = {
    "housing.com": 0.9, "99acres.com": 0.9, "magicbricks.com": 0.9, "squareyards.com": 0.88, "proptiger.com": 0.85,
    "makaan.com": 0.85, "commonfloor.com": 0.78, "zricks.com": 0.8, "roofandfloor.com": 0.78, "anarock.com": 0.8,
    "homebazaar.com": 0.72, "propequity.in": 0.8, "realestateindia.com": 0.5, "indiaproperty.com": 0.5,
    "propertywala.com": 0.5, "dealacres.com": 0.5, "nobrokerage.com": 0.5, "keralarealestate.in": 0.5,
    "housiey.com": 0.75, "homznspace.com": 0.6, "propsamc.com": 0.6, "squarefeetgroup.com": 0.5,
}
DEFAULT_WEIGHT, OFFICIAL_WEIGHT, MIRROR_WEIGHT = 0.45, 1.0, 0.85
TRUSTED_PORTALS = ["housing.com", "99acres.com", "magicbricks.com", "squareyards.com", "proptiger.com", "makaan.com", "commonfloor.com", "housiey.com", "roofandfloor.com", "zricks.com", "anarock.com"]
MAJOR_PORTALS = ["housing.com", "99acres.com", "magicbricks.com", "squareyards.com", "proptiger.com", "makaan.com"]
BLOCKED_HOSTS = ["nobroker.in", "youtube.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "quora.com", "reddit.com", "pinterest.com", "pinterest.in", "t.me", "whatsapp.com", "justdial.com", "sulekha.com", "quikr.com", "olx.in", "wikipedia.org", "scribd.com", "slideshare.net", "threads.net"]
OFFICIAL_HOSTS = ["up-rera.in", "tnrera.in", "maharera.mahaonline.gov.in"]
TRUSTED_TIERS = ["official", "rera-mirror", "portal", "project-site"]
AGGREGATE_URL = (
    r"new-projects?-in|projects?-in-|flats?-for-sale|propert(?:y|ies)-for-sale|apartments?-for-sale|houses?-for-sale|villas?-for-sale|plots?-for-sale|for-sale-in|-pppfs|/property/buy/|for-rent|/rent/"
    r"|/search|/srp|[?&](?:q|query|keyword)=|/builders?/|/developers?/|/localit(?:y|ies)/|-prjtl|/news/|/top-\d+|best-(?:projects|flats|apartments)|upcoming-projects"
    r"|ready-to-move-(?:flats|projects|apartments)|under-construction-(?:flats|projects)|/compare|resale|/updates?/|/blogs?/|/articles?/"
)
PROJECT_PAGE_MARK = "/buy/projects/page/"
AGGREGATE_TITLE = (
    r"^\s*(?:\d+\+?\s+|top\s+\d*\s*|best\s+|new\s+|upcoming\s+|latest\s+|ready\s+to\s+move\s+|resale\s+|under\s+construction\s+)*"
    r"(?:projects|flats|apartments|properties|property|homes|houses|villas|plots|\d\s*bhk|residential\s+projects)\b"
)

# ---- fixed values: names and places
GENERIC_WORDS = "apartment apartments apts apt residency residences residence residential heights height tower towers enclave society chs cghs co op operative housing homes home villas villa project projects estate estates park gardens garden city complex plaza nagar flat flats building buildings bldg ltd pvt limited phase block wing sector plot new premium luxury".split()
STOP_WORDS = "the and of at in by a an on".split()
SIMILARITY_GENERIC = GENERIC_WORDS + STOP_WORDS + "by m s ms pvt private ltd llp infra developers constructions projects group the".split()
PLACE_FILLER = "east west north south road main nagar colony phase sector layout extension new old city town village stage block cross near".split()
CITY_ALIASES = {
    "bangalore": "bengaluru", "gurgaon": "gurugram", "bombay": "mumbai", "calcutta": "kolkata", "madras": "chennai",
    "poona": "pune", "trivandrum": "thiruvananthapuram", "mysore": "mysuru", "baroda": "vadodara", "cochin": "kochi",
    "vizag": "visakhapatnam", "mangalore": "mangaluru", "belgaum": "belagavi", "hubli": "hubballi",
    "pondicherry": "puducherry", "calicut": "kozhikode",
}
CITY_REGIONS = [
    ["mumbai", "bombay", "thane", "navi mumbai", "mira road", "mira bhayandar", "bhayandar", "kalyan", "dombivli", "vasai", "virar", "panvel", "ulwe", "kharghar", "badlapur", "ambernath", "palghar", "boisar", "karjat", "neral"],
    ["pune", "pimpri", "chinchwad", "pimpri chinchwad", "pcmc"],
    ["bangalore", "bengaluru"],
    ["hyderabad", "secunderabad", "cyberabad"],
    ["chennai", "madras"],
    ["delhi", "new delhi", "gurgaon", "gurugram", "noida", "greater noida", "ghaziabad", "faridabad", "sonipat", "sohna", "bhiwadi", "dharuhera"],
    ["kolkata", "calcutta", "howrah"],
    ["ahmedabad", "gandhinagar"],
    ["chandigarh", "mohali", "zirakpur", "panchkula", "kharar"],
    ["kochi", "cochin", "ernakulam"],
    ["mysore", "mysuru"],
    ["visakhapatnam", "vizag"],
    ["vadodara", "baroda"],
    ["thiruvananthapuram", "trivandrum"],
    ["mangalore", "mangaluru"],
] + [[c] for c in "coimbatore jaipur lucknow indore bhopal nagpur nashik surat bhubaneswar vijayawada goa dehradun rajkot ludhiana patna ranchi raipur kanpur agra varanasi guntur nellore hubli madurai".split()]
#: Name, latitude, longitude, radius in km.
CITY_CENTERS = [
    ("Bangalore", 12.9716, 77.5946, 45), ("Hyderabad", 17.3850, 78.4867, 45), ("Chennai", 13.0827, 80.2707, 45),
    ("Mumbai", 19.0760, 72.8777, 25), ("Thane", 19.2183, 72.9781, 14), ("Navi Mumbai", 19.0330, 73.0297, 16),
    ("Mira Bhayandar", 19.2952, 72.8544, 7), ("Vasai Virar", 19.4259, 72.8225, 13), ("Kalyan Dombivli", 19.2350, 73.1300, 12),
    ("Panvel", 18.9894, 73.1175, 11), ("Pune", 18.5204, 73.8567, 35), ("Gurgaon", 28.4595, 77.0266, 20),
    ("Noida", 28.5355, 77.3910, 13), ("Greater Noida", 28.4744, 77.5040, 15), ("Ghaziabad", 28.6692, 77.4538, 14),
    ("Faridabad", 28.4089, 77.3178, 15), ("Delhi", 28.6139, 77.2090, 22), ("Kolkata", 22.5726, 88.3639, 30),
    ("Ahmedabad", 23.0225, 72.5714, 30), ("Gandhinagar", 23.2156, 72.6369, 12), ("Chandigarh", 30.7333, 76.7794, 20),
    ("Coimbatore", 11.0168, 76.9558, 25), ("Kochi", 9.9312, 76.2673, 25), ("Jaipur", 26.9124, 75.7873, 25),
    ("Lucknow", 26.8467, 80.9462, 25), ("Indore", 22.7196, 75.8577, 20), ("Nagpur", 21.1458, 79.0882, 20),
    ("Nashik", 19.9975, 73.7898, 15), ("Surat", 21.1702, 72.8311, 20), ("Vadodara", 22.3072, 73.1812, 18),
    ("Mysore", 12.2958, 76.6394, 15), ("Visakhapatnam", 17.6868, 83.2185, 20), ("Bhubaneswar", 20.2961, 85.8245, 18),
    ("Goa", 15.4909, 73.8278, 40),
]
STATES = ["maharashtra", "karnataka", "telangana", "tamil nadu", "kerala", "gujarat", "haryana", "uttar pradesh", "delhi", "new delhi", "west bengal", "andhra pradesh", "rajasthan", "madhya pradesh", "punjab", "goa", "odisha", "bihar", "uttarakhand", "chandigarh", "jharkhand", "chhattisgarh", "assam", "india", "ncr", "delhi ncr"]
CITY_LIKE = ["navi mumbai", "thane", "pimpri chinchwad", "greater noida", "noida", "gurugram", "gurgaon", "ghaziabad", "faridabad", "mira bhayandar", "kalyan dombivli", "vasai virar", "secunderabad", "new town", "howrah", "mumbai suburban", "bengaluru urban", "bangalore urban", "rangareddy", "ranga reddy", "medchal malkajgiri", "sangareddy", "palghar", "raigad", "chengalpattu", "kancheepuram", "tiruvallur", "pune district", "hyderabad district"]
ADDRESS_NOISE = r"(?i)\b(road|rd|cross|main|street|st|lane|marg|highway|hwy|near|opp|opposite|behind|floor|plot|survey|sy|off)\b"
#: Latitude from, to; longitude from, to.
DISCOVERY_BOX = (16.9, 18.0, 77.9, 79.1)
# Where questions to the geocoder lie, the parts of its addresses that name a locality and a city, and what a city's name ends in.
GEOCODED_IN = ("Hyderabad", "Telangana", "India")
ADDRESS_LOCALITY = ("suburb", "neighbourhood", "quarter", "village")
ADDRESS_CITY = ("city", "town", "state_district", "county")
CITY_SUFFIX = r"(?i)\s+(suburban|urban|rural|district|division)\b"
PLACE_TERMS = ["apartment complex", "gated community", "commercial building"]
PLACE_CATEGORIES = r"(?i)apartment|housing|condominium|residential|villa|gated|township|commercial building|business park|office building|it park|business center|tech park"
LISTING_SITES = {"99acres": "99acres.com", "magicbricks": "magicbricks.com", "housing": "housing.com", "squareyards": "squareyards.com"}
REGISTER_TYPES = ["residential", "commercial", "mixed"]
REGISTER_ID = r"\b(P0\d{10})\b"
#: Names too wide to be a locality.
WIDE_PLACES = ["hyderabad", "secunderabad", "telangana"]
LOCALITY_JUNK = r"(?i)\d|\b(near|opp|opposite|beside|behind|besides|ward|survey|sy|plot|road|rd|street|lane|x ?roads?|junction|circle|main|block|phase|part|adjacent)\b"
LOCALITY_SUFFIX = r"(?i)\s*(\(.*?\)|\b(village|mandal|municipality|telangana|hyderabad|old village|gp|nagar panchayat)\b)\s*"

# ---- fixed values: dates
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MIN_YEAR, YEARS_AHEAD = 1950, 12
PRECISION_FACTOR = {"day": 1.0, "month": 1.0, "quarter": 0.9, "year": 0.65}
#: Kind, weight, pattern; the earlier one wins where two start at one place.
DATE_KEYWORDS = [
    ("extension", 1.0, r"(?:rera\s+)?extension(?:\s+(?:date|upto|up\s+to|till|until|granted|valid\s+(?:till|upto)))?|extended\s+(?:up\s*to|till|until|to)"),
    ("rera", 1.0, r"rera\s+(?:possession|completion)(?:\s+date)?|proposed\s+date\s+of\s+completion|revised\s+(?:proposed\s+)?(?:date\s+of\s+)?completion(?:\s+date)?"),
    ("possession", 1.0, r"possession(?:\s+(?:date|starts?|by|from|in|on|time|due|expected|timeline|status))?"),
    ("completion", 0.85, r"completion(?:\s+(?:date|by|in|on|year|time))?|completed\s+(?:on|in|by)"),
    ("handover", 0.85, r"hand\s*-?\s*over(?:\s+(?:date|by|in|from))?"),
    ("ready", 0.8, r"ready\s+to\s+move(?:[\s\-]in)?(?:\s+(?:since|from|in|by))?|ready\s+for\s+possession(?:\s+(?:since|from|in|by))?|occupancy\s+certificate(?:\s+(?:received|obtained|date))?"),
    ("built", 0.75, r"(?:built|constructed)\s+in|year\s+(?:of\s+)?(?:construction|built|completion)|construction\s+year|built\s+year"),
]
REGISTER_KINDS = ["rera", "extension"]
WINDOW = 60
STOP_PATTERN = (
    r"launch|registration|registered|rera\s*(?:no|id|number|reg)|valid\s+(?:till|upto|up\s+to)|price|₹|\brs\.?\s|\binr\b|sq\.?\s*ft|sqft|\bbhk\b|configuration|\bunits?\b|\btowers?\b|\bacres?\b"
    r"|\bfloors?\b|updated|posted|listed|review|rating|\bemi\b|carpet|super\s+(?:built|area)|©|copyright|\bage\b|\bestd\b|established|founded"
)
STATUS_PATTERNS = {
    "Ready to Move": r"ready\s+to\s+move|ready\s+for\s+possession|immediate\s+possession|completed\s+project|possession\s+status\s*:?\s*(?:ready|immediate|completed)",
    "Under Construction": r"under[\s\-]+construction|new\s+launch|pre[\s\-]*launch|upcoming\s+project",
}
STRUCTURED_FIELD = r"[\"']?((?:expected|proposed|rera|actual|target)?_?(?:possession|completion|handover)_?(?:date|time|by|start|starts|startdate|on)?)[\"']?\s*:\s*[\"']?([^\"',}\]<\n]{2,40})"

# ---- fixed values: prices
PRICE_UNIT = r"(cr|crores?|crs?|lakhs?|lacs?|lac|l)\b"
PRICE_NUMBER = r"(\d{1,3}(?:\.\d{1,2})?)"
RUPEE = r"(?:₹|rs\.?|inr)"
NOT_PRICE = r"\b(?:emi|booking|token|maintenance|registration|stamp|rent|deposit|charges?|gst|loan|income|salary|turnover|revenue|invest|worth|valuation|project\s+cost|funding|raised|sales\s+of|crore\s+project|deal|acquir)"
CAROUSEL = r"similar|you\s+may\s+(?:also\s+)?like|other\s+projects|nearby|recommended|also\s+viewed|trending|newly\s+launched|more\s+projects|projects\s+(?:in|near|by)|top\s+projects|explore|don.?t\s+miss|popular|featured|sponsored"
MIN_PRICE, MAX_PRICE = 5e5, 1.5e9
KIND_RANK = {"page data": 4, "range": 3, "onwards": 2, "single": 1}

# ---- fixed values: provider and review accounting
PROVIDER_MIN_SCORE, PROVIDER_MAX_KM, PROVIDER_NEAR_KM, PROVIDER_FAR_KM = 0.8, 60.0, 3.0, 8.0
TOKENS_PER_CHAR, PROMPT_TOKENS = 3.5, 900
SEARCH_USD, BATCH_DISCOUNT, CACHE_WRITE, CACHE_READ = 0.01, 0.5, 1.25, 0.1

# The labels of register pages and the texts that stand between them.
PROJECT_LABELS = {
    "project_type": "Project Type",
    "status": "Project Status",
    "approved": "Approved Date",
    "proposed_completion": "Proposed Date of Completion",
    "revised_completion": "Revised Proposed Date of Completion",
}
PROJECT_STOPS = ("Are there", "Is the", "Address Details")
ADDRESS_HEADING = "Address Details"
ADDRESS_LABELS = {
    "district": "District",
    "mandal": "Mandal",
    "village": "Village/City/Town",
    "street": "Street",
    "locality": "Locality",
    "pin": "Pin Code",
}
ADDRESS_STOPS = ("Land mark", "Landmark")
NO_VALUE = ("na", "n/a", "-")
#: Longest value of a label; longer ones are the page's other text.
VALUE_CHARS = 80

# Which addresses of a listing site are project pages, and where their fields stand.
LISTING_PAGES = {
    "housing": {
        "page": r"housing\.com/in/buy/projects/page/\d+-([^/?#]+)",
        "name": (("slug", r"^(.*?)(?:-by-.*)?$"),),
        "locality": (("title", r"\bin\s+([^,|-]+),\s*Hyderabad"),),
        "builder": (("slug", r"-by-(.*?)(?:-in-[a-z0-9-]+)?$"),),
    },
    "squareyards": {
        "page": r"squareyards\.com/hyderabad-(?:residential|commercial)-property/([^/]+)/\d+/project",
        "name": (("title", r"^(.*?)(?:,| - |$)"),),
        "locality": (("title", r"^(?:(?! - )[^,])*,((?:(?! - )[^,])*),"),),
        "builder": (),
    },
    "magicbricks": {
        "page": r"magicbricks\.com/([^/?#]+?)-pdpid-",
        "name": (("title", r"^(.+?)\s+in\s+[^,|]+,\s*Hyderabad"), ("title", r"^([^,]*)")),
        "locality": (("title", r"^.+?\s+in\s+([^,|]+),\s*Hyderabad"),),
        "builder": (),
    },
    "99acres": {
        "page": r"99acres\.com/([^/?#]+?)-npxid-r\d+",
        "name": (("title", r"^([^,]*)"),),
        "locality": (),
        "builder": (),
    },
}
LISTING_NOISE = r"(?i)\b(?:FAQs?|Price List|Prices?|Reviews?|Floor Plans?|Brochure|Resale|Photos|Overview|Rera)\b.*$"

# The two labels of a completion date that was changed.
FIRST_COMPLETION = r"(?i)(?:original|proposed)(?:\s+proposed)?(?:\s+date\s+of)?\s+completion(?:\s+date)?\s*[:\-]?"
NEXT_COMPLETION = r"(?i)revised(?:\s+proposed)?(?:\s+date\s+of)?\s+completion(?:\s+date)?\s*[:\-]?"
#: Characters in which a completion date follows its label.
COMPLETION_CHARS = 40

# Rupee amounts in evidence, and in listings, which have their own grammar.
PRICE_RANGE = rf"(?i){RUPEE}\s*{PRICE_NUMBER}\s*(?:{PRICE_UNIT})?\s*(?:-|–|—|to)\s*{RUPEE}?\s*{PRICE_NUMBER}\s*{PRICE_UNIT}"
PRICE_ONE = rf"(?i){RUPEE}\s*{PRICE_NUMBER}\s*{PRICE_UNIT}(?!\s*(?:/|per)\s*(?:sq|month))"
PRICE_FULL = rf"(?i){RUPEE}\s*(\d{{1,3}}(?:,\d{{2,3}}){{2,4}})(?!\s*(?:/|per|\d))"
PRICE_PER_SQFT = rf"(?i){RUPEE}\s*([\d,]{{3,7}}|\d+(?:\.\d+)?\s*k)\s*(?:/|per)\s*(?:sq\.?\s*ft|sqft|sq\.?\s*feet)"
LISTING_UNIT = r"(cr|crores?|l|lacs?|lakhs?)"
LISTING_RANGE = rf"(?i)(?:₹|rs\.?|inr)\s*(\d+(?:\.\d+)?)\s*{LISTING_UNIT}?\s*(?:-|–|to)\s*(?:₹|rs\.?|inr)?\s*(\d+(?:\.\d+)?)\s*{LISTING_UNIT}\b"
LISTING_ONE = rf"(?i)(?:₹|rs\.?|inr)\s*(\d+(?:\.\d+)?)\s*{LISTING_UNIT}\b"
LISTING_SQFT = r"(?i)(?:₹|rs\.?|inr)\s*([\d,]{3,7})\s*(?:/|per)\s*sq\.?\s*ft"
#: Characters before an amount in which the project's name has to stand, and around the name that are compared with it.
NAME_BEFORE, NAME_AROUND = 220, 45
# A builder's name after "by" in a title, and what is a date there instead.
TITLE_BUILDER = r"\bby\s+([A-Z][\w&.'\- ]{2,40}?)(?=\s*(?:[|\-,:(]|in\b|at\b|$))"
TITLE_DATE = r"(?i)^(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?(?:\s|$)|\d)"
