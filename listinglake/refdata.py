"""Fixed values of the listing domain."""

# Authority of each publisher, higher wins.
SOURCE_TRUST = {"organizer_website": 5, "mlh": 4, "unstop": 4, "devpost": 4, "hackerearth": 3}

# Words that say nothing about which event a title names.
TITLE_NOISE = (
    "hackathon hack hacks hackthons the a an of and for in at 20 edition ed annual grand national international official invitational "
    "season series challenge competition contest fest code coding tech technothon hackfest summit meet up x by is live online offline"
).split()

# Month names and their usual short forms.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10,
    "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sept": 9, "sep": 9, "oct": 10,
    "nov": 11, "dec": 12,
}

# Zone abbreviations and their offsets in minutes. British summer time counts as +60 and Israel's as +180.
ZONE_OFFSETS = {
    "utc": 0, "gmt": 0, "z": 0, "ut": 0, "ist": 330, "idt": 180, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "mst": -420,
    "mdt": -360, "cst": -360, "cdt": -300, "est": -300, "edt": -240, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "sgt": 480, "sst": 480, "jst": 540, "kst": 540, "hkt": 480, "gst": 240, "pk": 300,
    "npt": 345, "brt": -180, "art": -180, "sa": -180, "wib": 420, "wita": 480, "pht": 480,
}

# Keywords for tags.
THEME_KEYWORDS = (
    "artificial intelligence", "machine learning", "ai/ml", "blockchain", "web3", "cybersecurity", "web development", "mobile", "cloud", "iot",
    "healthcare", "fintech", "open source", "devops", "quantum", "climate", "social good", "space", "gaming", "ar/vr", "computer vision",
)
TECH_KEYWORDS = (
    "python", "javascript", "typescript", "react", "node.js", "django", "flask", "java", "c++", "go lang", "rust", "kotlin", "swift", "flutter",
    "tensorflow", "pytorch", "aws", "azure", "gcp", "docker", "kubernetes", "solidity", "postgresql", "mongodb", "firebase",
)
CURRENCY_SIGNS = {"₹": "INR", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
MONEY_UNITS = {
    "k": 1_000, "thousand": 1_000, "lakh": 100_000, "lakhs": 100_000, "lacs": 100_000, "crore": 10_000_000, "crores": 10_000_000,
    "m": 1_000_000, "million": 1_000_000,
}

# Words that may stand beside a known place name.
PLACE_QUALIFIERS = "urban city district north south east west central greater new metro metropolitan region area sub".split()

# Regions and countries that may follow a place name.
REGION_NAMES = (
    "andhra pradesh", "assam", "bihar", "chandigarh", "delhi", "goa", "gujarat", "haryana", "karnataka", "kerala", "madhya pradesh", "maharashtra",
    "odisha", "punjab", "rajasthan", "tamil nadu", "telangana", "uttar pradesh", "uttarakhand", "west bengal", "california", "new york",
    "massachusetts", "texas", "washington", "ontario", "quebec", "england", "scotland", "greater london", "berlin", "new south wales", "victoria",
)
COUNTRY_NAMES = (
    "india", "united states", "united states of america", "usa", "us", "canada", "united kingdom", "uk", "in", "germany", "netherlands", "france",
    "singapore", "japan", "australia",
)

# Default places: name, region, country code, metro, locality, aliases. A larger registry is passed as a table of the same columns.
PLACES = (
    ("Mumbai", "Maharashtra", "IN", "mumbai", False, ("Bombay", "Mumbai City")),
    ("Navi Mumbai", "Maharashtra", "IN", "mumbai", True, ("New Mumbai",)),
    ("Thane", "Maharashtra", "IN", "mumbai", True, ()),
    ("Delhi", "Delhi", "IN", "delhi-ncr", False, ("New Delhi",)),
    ("Gurugram", "Haryana", "IN", "delhi-ncr", True, ("Gurgaon",)),
    ("Noida", "Uttar Pradesh", "IN", "delhi-ncr", True, ()),
    ("Bengaluru", "Karnataka", "IN", "bengaluru", False, ("Bangalore",)),
    ("Whitefield", "Karnataka", "IN", "bengaluru", True, ()),
    ("Chennai", "Tamil Nadu", "IN", "chennai", False, ("Madras",)),
    ("Ambattur", "Tamil Nadu", "IN", "chennai", True, ()),
    ("Hyderabad", "Telangana", "IN", "hyderabad", False, ()),
    ("Secunderabad", "Telangana", "IN", "hyderabad", True, ()),
    ("Pune", "Maharashtra", "IN", "pune", False, ("Poona",)),
    ("Kolkata", "West Bengal", "IN", "kolkata", False, ("Calcutta",)),
    ("Ahmedabad", "Gujarat", "IN", "ahmedabad", False, ("Amdavad",)),
    ("Kochi", "Kerala", "IN", "kochi", False, ("Cochin",)),
    ("Jaipur", "Rajasthan", "IN", "jaipur", False, ()),
    ("Lucknow", "Uttar Pradesh", "IN", "lucknow", False, ()),
    ("New York", "New York", "US", "new-york", False, ("NYC", "New York City")),
    ("Brooklyn", "New York", "US", "new-york", True, ()),
    ("San Francisco", "California", "US", "bay-area", False, ("SF",)),
    ("Berkeley", "California", "US", "bay-area", True, ()),
    ("London", "England", "GB", "london", False, ()),
    ("Toronto", "Ontario", "CA", "toronto", False, ()),
    ("Berlin", "Berlin", "DE", "berlin", False, ()),
    ("Singapore", None, "SG", None, False, ()),
)

# Great-circle radius in km, km of a degree of latitude.
EARTH_KM, DEGREE_KM = 6371.0088, 111.32
