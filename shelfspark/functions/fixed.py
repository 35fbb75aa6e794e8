"""Fixed values that results depend on (word lists, keys, constants).

These are stated plainly and in their natural order; changing any of them
changes results.
"""

# --- fixed values: query understanding -----------------------------------
KNOWN_BRANDS = [
    "Roots", "Lululemon", "Canada Goose", "Aritzia", "Province of Canada",
    "Mejuri", "Duer", "Reigning Champ", "Arc'teryx", "Mackage", "Moose Knuckles",
    "Naked & Famous", "Wings+Horns", "Frank And Oak", "Tentree", "Kotn",
    "Baffin", "Kamik", "Sorel", "Native Shoes",
]
# the first is looked for in text whose hyphens are read as blanks
ORIGIN_KEYWORDS = ["made in canada", "canadian made", "fabriqué au canada"]
MAX_PRICE_WORDS = r"(?:under|less than|below|max|<)"
MIN_PRICE_WORDS = r"(?:over|more than|above|min|>)"
ORIGIN_PHRASES = r"(?:made[- ]?in[- ]?canada|canadian[- ]?made|fabriqué au canada)"
PRICE_NUMBER = r"(\d+(?:\.\d{2})?)"
PRICE_RANGE_JOINER = r"\s*[-–to]+\s*"
RATING_PHRASE = r"(\d+(?:\.\d)?)\+?\s*(?:stars?|rating)"

# --- fixed values: product-name normalisation -----------------------------
SIZE_WORDS = r"(xs|s|m|l|xl|xxl|xxxl|os|one\s*size|small|medium|large|x-?large|xx-?large|size\s+\w+)"
COLOR_WORDS = [
    "black", "white", "grey", "gray", "charcoal", "navy", "blue", "red", "green", "brown", "tan",
    "beige", "cream", "ivory", "pink", "purple", "orange", "yellow", "olive", "burgundy", "maroon",
    "teal", "coral", "salmon", "heather", "oatmeal", "natural", "midnight", "forest", "hunter", "sky",
    "royal", "slate", "stone", "sand", "camel", "cognac", "rust", "wine", "plum", "lavender", "mint",
    "sage", "moss", "cedar", "walnut", "mahogany", "espresso", "chocolate", "mocha", "latte",
    "vanilla", "snow", "arctic", "onyx", "jet", "raven", "ink", "graphite", "pewter", "silver",
    "gold", "bronze", "copper", "rose", "blush", "dusty", "faded", "washed", "vintage",
]
GENDER_PREFIX = r"^(men'?s?|women'?s?|kid'?s?|unisex|ladies'?)\s+"
MODIFIER_WORDS = [
    "classic", "original", "premium", "lightweight", "heavyweight", "printed", "logo", "slim",
    "relaxed", "oversized", "fitted", "regular", "cropped", "long", "short",
]
PRODUCT_TYPES = [
    "hoodie", "hoody", "sweatshirt", "sweater", "jacket", "coat", "parka",
    "t-shirt", "tee", "shirt", "polo", "tank", "top", "blouse",
    "pants", "jeans", "shorts", "joggers", "leggings", "skirt", "dress",
    "boots", "shoes", "sneakers", "sandals", "slippers",
    "hat", "cap", "beanie", "toque", "scarf", "gloves", "mittens",
    "bag", "backpack", "tote", "wallet", "belt",
]
URL_SIZE_TOKENS = r"-?(xs|s|m|l|xl|xxl|xxxl)(-|$)"

# display-name clean-up for result cards
CARD_SIZE_TAIL = (r"\s*[-–]\s*(Unisex|Men'?s?|Women'?s?|Kids?|Junior|Jr\.?)?\s*[-–]?\s*"
                  r"(XXS|XS|S|M|L|XL|XXL|XXXL|2XL|3XL|Small|Medium|Large|X-Large|XX-Large|One Size).*$")
CARD_BIG_SIZE_TAIL = r"\s*[-–]?\s*(XXS|XS|XXL|XXXL|2XL|3XL)\s*$"
CARD_GENDER_TAIL = r"\s*[-–]\s*(Unisex|Men'?s?|Women'?s?)\s*$"

SITE_TO_BRAND = {
    "provinceofcanada.com": "Province of Canada",
    "muttonheadstore.com": "Muttonhead",
    "www.mtnhead.com": "Muttonhead",
    "roots.com": "Roots",
    "www.roots.com": "Roots",
}

# --- fixed values: ranking --------------------------------------------------
SQL_CANDIDATES = 250
INITIAL_SEARCH_LIMIT = 100
RERANK_TOP_N = 50
RATING_PRIOR = 4.0
RATING_CONFIDENCE = 10
MIN_REVIEWS_FOR_TRUST = 10
ALPHA = 0.5
ORIGIN_BOOST_MAIN = 0.2
ORIGIN_BOOST_API = 0.3
MAX_DESCRIPTION_LENGTH = 500

# --- fixed values: manufacturing-location rules (checked in this order) ----
# (needle contained in the lower-cased location, label)
CANADIAN_INDICATORS = [
    ("ontario", "Ontario"), ("quebec", "Quebec"), ("british columbia", "British Columbia"),
    ("alberta", "Alberta"), ("manitoba", "Manitoba"), ("saskatchewan", "Saskatchewan"),
    ("nova scotia", "Nova Scotia"), ("new brunswick", "New Brunswick"), ("newfoundland", "Newfoundland"),
    ("prince edward island", "PEI"), ("pei", "PEI"), ("yukon", "Yukon"),
    ("northwest territories", "NWT"), ("nunavut", "Nunavut"), ("canada", "Canada"),
    (", on", "Ontario"), (", qc", "Quebec"), (", bc", "British Columbia"), (", ab", "Alberta"),
    (", mb", "Manitoba"), (", sk", "Saskatchewan"), (", ns", "Nova Scotia"), (", nb", "New Brunswick"),
    (", nl", "Newfoundland"), (", pe", "PEI"), (", yt", "Yukon"), (", nt", "NWT"), (", nu", "Nunavut"),
    ("toronto", "Toronto, ON"), ("montreal", "Montreal, QC"), ("montréal", "Montreal, QC"),
    ("vancouver", "Vancouver, BC"), ("calgary", "Calgary, AB"), ("edmonton", "Edmonton, AB"),
    ("ottawa", "Ottawa, ON"), ("winnipeg", "Winnipeg, MB"), ("quebec city", "Quebec City, QC"),
    ("hamilton", "Hamilton, ON"), ("kitchener", "Kitchener, ON"), ("london", "London, ON"),
    ("victoria", "Victoria, BC"), ("halifax", "Halifax, NS"), ("oshawa", "Oshawa, ON"),
    ("windsor", "Windsor, ON"), ("saskatoon", "Saskatoon, SK"), ("regina", "Regina, SK"),
    ("st. john's", "St. John's, NL"), ("barrie", "Barrie, ON"), ("kelowna", "Kelowna, BC"),
    ("abbotsford", "Abbotsford, BC"), ("sudbury", "Sudbury, ON"), ("kingston", "Kingston, ON"),
    ("guelph", "Guelph, ON"), ("moncton", "Moncton, NB"), ("mississauga", "Mississauga, ON"),
    ("brampton", "Brampton, ON"), ("markham", "Markham, ON"), ("vaughan", "Vaughan, ON"),
    ("burnaby", "Burnaby, BC"), ("surrey", "Surrey, BC"), ("laval", "Laval, QC"),
    ("longueuil", "Longueuil, QC"), ("gta", "Greater Toronto Area"), ("greater toronto", "Greater Toronto Area"),
]
CANADIAN_PHRASES = [
    "completely canadian", "100% canadian", "canadian made", "canadian-made", "made in canada",
    "proudly canadian", "canadian owned and operated", "canadian company", "canadian family",
    "family-owned canadian", "canadian manufacturer", "manufactured in canada", "produced in canada",
    "crafted in canada", "handmade in canada", "locally made", "locally manufactured",
    "domestic manufacturing",
]
NON_CANADIAN_INDICATORS = [
    "usa", "united states", "china", "mexico", "germany", "france", "italy", "japan", "korea",
    "taiwan", "vietnam", "india", "bangladesh",
]

# --- fixed values: listing pages -------------------------------------------
LISTING_FIELD_PATTERNS = {
    "name": r"(?:Name|Company):\s*(.+?)(?:\n|$)",
    "products": r"Products?:\s*(.+?)(?:\n|$)",
    "manufactured_in": r"(?:Manufactured In|Manufacturing Location|Made In):\s*(.+?)(?:\n|$)",
    "where_to_buy": r"(?:Where to Buy|Available At|Buy At):\s*(.+?)(?:\n|$)",
    "website": r"Website:\s*(\S+?)(?:\s|\n|$)",
    "canadian_owned_text": r"(?:Canadian[- ]?Owned|Ownership):\s*(.+?)(?:\n|$)",
}
WEBSITE_PATTERN_FULL_LINE = r"Website:\s*(.+?)(?:\n|$)"
DESCRIPTION_SKIP_PREFIXES = ["Name:", "Products:", "Manufactured", "Website:", "Where to", "Canadian"]
HOMEPAGE_CATEGORY = "Homepage"
TITLE_MARKERS = ["🍁", "📈"]

# --- fixed values: review markup on product pages (checked in this order) ---
REVIEW_JSON_VAR = r"MetafieldReviews\s*=\s*(\{[^;]+\});?"
REVIEW_VENDORS = [
    ("Yotpo", "MetafieldYotpoRating", "MetafieldYotpoCount"),
    ("Loox", "MetafieldLooxRating", "MetafieldLooxCount"),
    ("Okendo", "okendoProductReviewAverageValue", "okendoProductReviewCount"),
]
REVIEW_RATING_VALUE = r"""\s*=\s*["']?([0-9.]+)["']?"""
REVIEW_COUNT_VALUE = r"""\s*=\s*["']?(\d+)["']?"""

# --- fixed values: job log lines ---------------------------------------------
LOG_PRODUCTS_FOUND = r"Found (\d+) product URLs?"
LOG_PRODUCTS_SAVED = r"Saved (\d+) products? to PostgreSQL"
LOG_CATEGORIES_FOUND = r"Found (\d+) category pages?"
LOG_IMAGES = r"🖼️ Extracted (\d+) image"

# --- fixed values: file names and store types ------------------------------
UNSAFE_FILE_CHARS = "[^a-zA-Z0-9._-]+"
STORE_CATEGORY_PATTERNS = {
    "shopify": ["/collections/"],
    "roots": ["/women/", "/men/", "/kids/", "/leather/", "/sale/", "/gifts/"],
    "generic": [
        "/collections/", "/category/", "/categories/", "/shop/",
        "/women/", "/men/", "/kids/", "/sale/", "/new/",
        "/accessories/", "/clothing/", "/shoes/", "/bags/",
    ],
}
STORE_PRODUCT_PATTERNS = {
    "shopify": r"/products/",
    "roots": r"-\d+\.html",
    "generic": r"/products/|/product/|-\d+\.html|/p/[^/]+",
}

# --- fixed values: wording of reasons and of the text a relevance model scores ---
REASON_SECOND_SOURCE = "AI extraction"
REASON_OWNED = "Page explicitly states Canadian-Owned: '{}'"
REASON_NOT_OWNED = "Page states not Canadian-Owned: '{}'"
REASON_OWNERSHIP_UNKNOWN = "No Canadian ownership information found on page"
REASON_CANADIAN_PLACE = "' contains Canadian indicator: {}"
REASON_CANADIAN_PHRASE = "Text implies Canadian manufacturing: '{}'"
REASON_FOREIGN_PLACE = "' indicates non-Canadian manufacturing ({})"
REASON_NO_LOCATION = "No manufacturing location provided"
REASON_NO_WEBSITE = "No website URL provided"
REASON_FETCH_FAILED = "meta.json fetch failed"
REASON_STOREFRONT = "Found meta.json (myshopify_domain={})"
REASON_NO_STOREFRONT_FIELDS = "meta.json missing Shopify fields"
REASON_NO_JSON = "meta.json not valid JSON"
REASON_HTTP_STATUS = "meta.json HTTP {}"
RERANK_NAME = "Product Name: "
RERANK_BRAND = " \n\nBrand Name: "
RERANK_PRICE = "\n\nPrice: "
RERANK_MADE = "\n\nMADE IN CANADA: YES - VERIFIED CANADIAN MANUFACTURED"
RERANK_NOT_MADE = "\n\nMade in Canada: NO - NOT CANADIAN MADE"
RERANK_MADE_UNKNOWN = "\n\nMade in Canada: UNKNOWN - UNVERIFIED"
RERANK_REASON = "\n\n(Reason: {})"
RERANK_NO_REVIEWS = "\n\nQuality Score: N/A (No reviews)"
RERANK_REVIEWS = "\n\nQuality Score: {}/5 ({} reviews)"
RERANK_DESCRIPTION = "\n\nDescription: "
MAX_PAGE_TEXT_LENGTH = 500
