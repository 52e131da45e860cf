"""Word lists, domain lists, patterns and weights.

Every operator takes these as parameters; the values here are the defaults.
They are data that decides results, so they are written out plainly.
"""

# ---- fixed values: domains -------------------------------------------------
BLACKLIST_DOMAINS = [
    "facebook.com", "instagram.com", "x.com", "twitter.com", "linkedin.com",
    "youtube.com", "amazon.com", "pinterest.com", "tiktok.com", "yelp.com",
    "wikipedia.org", "tripadvisor.com", "medium.com", "reddit.com",
]
SEARCH_ENGINE_DOMAINS = [
    "bing.com", "www.bing.com", "duckduckgo.com", "www.duckduckgo.com",
    "google.com", "www.google.com", "search.yahoo.com", "yahoo.com",
    "r.msn.com", "www.msn.com", "msn.com", "go.microsoft.com",
    "r.bing.com", "c.bing.com",
]
BUSINESS_DIRECTORIES = [
    "yelp.com", "yellowpages.com", "superpages.com", "merchantcircle.com",
    "cylex-usa.com", "hotfrog.com", "businessyellow.com", "citysearch.com",
    "manta.com", "bizapedia.com", "yellowbook.com", "whitepages.com",
    "nextdoor.com", "foursquare.com", "factual.com",
]
BUSINESS_URL_DENY = [
    "facebook.com", "instagram.com", "twitter.com", "youtube.com",
    "amazon.com", "wikipedia.org",
]
ALLOWED_URL_BAD_PARTS = ["/search?", "/maps/", "translate.google", "/dir/", "/directories/"]
BUSINESS_URL_BAD_PARTS = ["/search?", "translate.google"]
OFFICIAL_URL_BAD_PARTS = ["/maps", "/search?", "facebook.com", "linkedin.com", "yelp.com", "yellowpages"]
SITE_DENY_SUBSTRINGS = [
    "facebook.com", "linkedin.com", "twitter.com", "instagram.com",
    "yelp.com", "yellowpages.com", "google.com", "maps.google.com",
    "tripadvisor.com", "foursquare.com", "mapquest.com", "bing.com",
    "yahoo.com", "craigslist.org", "indeed.com", "glassdoor.com",
    "wikipedia.org", "youtube.com", "pinterest.com", "reddit.com",
    "wikileaks.org", "britannica.com", "wikivoyage.org", "usnews.com",
    "travel.usnews.com", "visithouston.com", "visithoustontexas.com",
    "torproject.org", "raytheon.com", "defense.gov", "cia.gov",
    "news.com", "cnn.com", "bbc.com", "reuters.com", "ap.org",
    "tourism.com", "travel.com", "hotels.com", "expedia.com",
    "airbnb.com", "booking.com", "government.gov", "state.gov",
    "mightyautoparts.com", "houstontx.gov", "recyclenet.org",
    "wasteadvantage.com", "scrapmonster.com", "brownbook.net",
    "distributors.mightyautoparts.com",
]
SITE_DIRECTORY_DOMAINS = [
    "salvage-parts.com", "recyclingmonster.com", "scrapmonster.com",
    "recyclecenter.com", "scrapmetaljunkie.com", "wasteadvantage.com",
    "recycle.net", "manta.com", "bizapedia.com", "brownbook.net",
    "superpages.com", "findcompany.com", "businessfinder.com",
]
SITE_DIRECTORY_PATHS = [
    "/directory/", "/listings/", "/business/", "/companies/", "/search/",
    "/find/", "/local/", "/reviews/", "/junk-yards/", "/recycling-center/",
    "/salvage-yards/", "/auto-parts/",
]
SITE_BUSINESS_WORDS = [
    "recycling", "scrap", "metal", "salvage", "waste", "environmental",
    "steel", "aluminum", "copper", "iron", "battery", "auto", "junk",
    "yard", "center", "depot", "recovery", "reclaim",
]
DIRECTORY_PAGE_DOMAINS = [
    "yellowpages.com", "yelp.com", "superpages.com", "manta.com",
    "bizapedia.com", "brownbook.net", "salvage-parts.com",
    "recyclingmonster.com", "scrapmonster.com", "recyclecenter.com",
    "scrapmetaljunkie.com", "wasteadvantage.com", "recycle.net",
]
DIRECTORY_PAGE_PHRASES = [
    "directory", "listing", "find businesses", "business directory",
    "company listing", "recycling centers near", "find recycling",
    "scrap yards near", "auto salvage near",
]
DIRECTORY_LINK_DENY = [
    "facebook.com", "twitter.com", "instagram.com", "linkedin.com",
    "youtube.com", "pinterest.com", "tiktok.com", "maps.google.com",
    "yelp.com", "yellowpages.com", "foursquare.com",
]
DIRECTORY_LINK_WORDS = ["scrap", "metal", "recycling", "salvage", "auto", "steel", "copper", "aluminum"]
INVALID_HOST_PARTS = [
    ".local", "localhost", "127.0.0.1", "192.168.", "10.0.0.",
    "example.com", "test.com", "dummy.com",
]
WEBSITE_SKIP_DOMAINS = [
    "facebook.com", "twitter.com", "instagram.com", "linkedin.com",
    "yelp.com", "google.com", "yellowpages.com", "whitepages.com",
    "bbb.org", "manta.com", "superpages.com",
]
SOCIAL_PROVIDERS = [
    "facebook.com", "instagram.com", "x.com", "twitter.com", "linkedin.com",
    "youtube.com", "t.me", "telegram.me", "wa.me", "whatsapp.com",
]
TOPIC_URL_TOKENS = ["scrap", "metal", "recycl"]
PAYWALLED_DOMAINS = [
    "wsj.com", "ft.com", "bloomberg.com", "economist.com",
    "nytimes.com", "washingtonpost.com", "theguardian.com",
]
PARSER_SUPPORTED_DOMAINS = [
    "ria.ru", "tass.ru", "interfax.ru", "kommersant.ru", "vedomosti.ru", "rg.ru",
    "metallurgprom.org", "metaltorg.ru", "metalinfo.ru", "steelland.ru",
    "reuters.com", "bbc.com", "cnn.com",
]
PARSER_BLOCKED_DOMAINS = [
    "wsj.com", "ft.com", "bloomberg.com", "metalbulletin.com", "kitco.com", "fastmarkets.com",
]

# ---- fixed values: article URL fragments -----------------------------------
ARTICLE_BAD_PATHS = [
    "/category/", "/section/", "/rubric/", "/tag/", "/archive/", "/search/",
    "/?s=", "&s=", "/products/", "/price-data/", "/author/", "/page/",
    "/contact/", "/about/", "/privacy/", "/terms/",
]
ARTICLE_BAD_QUERIES = ["?s=", "&s=", "search=", "page=", "cat="]
ARTICLE_GOOD_PATHS = [
    "/article/", "/story/", "/news/", "/202", "/20", "/новости/", "/статья/",
    "/news.html", "/article.html", "/commodities/", "/metals/", "/mining/",
    "/steel/", "/aluminum/", "/copper/", "/iron/", "/scrap/",
]
ARTICLE_LIKE_EXCLUDE = [
    "/category/", "/section/", "/tag/", "/archive/", "/search/",
    "/author/", "/page/", "/feed/", "/rss/", "/comments/",
    "/login/", "/register/", "/contact/", "/about/", "/privacy/",
    "/terms/", "/sitemap/", "/robots.txt", "/favicon.ico",
    ".jpg", ".png", ".gif", ".css", ".js", ".pdf", ".zip",
]
ARTICLE_LIKE_INCLUDE = [
    "/article/", "/news/", "/story/", "/post/", "/202", "/20",
    "/новости/", "/статья/", "/news.html", "/article.html",
    "-news-", "-article-", "-story-",
]
ARTICLE_PERMISSIVE_BAD_PATHS = ["/category/", "/section/", "/rubric/", "/tag/", "/archive/"]
ARTICLE_PERMISSIVE_BAD_QUERIES = ["?s=", "&s=", "search="]
NEWS_LINK_PATTERNS = [
    "/news/", "/novosti/", "/article/", "/statya/",
    "-news-", "-novosti-", "/lenta/", "/articles/",
]
NEWS_LINK_EXCLUDE = [
    "/tag/", "/category/", "/author/", "/page/",
    ".jpg", ".png", ".pdf", "/search/", "/login/",
]
NEWS_LINK_TERMS = [
    "сталь", "металл", "лом", "железо", "медь", "алюминий",
    "steel", "metal", "iron", "copper", "aluminum", "scrap",
]
SOURCE_CATEGORIES = ["business", "economy", "markets"]
SOURCE_URL_WORDS = ["metal", "steel", "scrap", "mining", "industry", "business"]
ENTRY_TERMS = [
    "металл", "сталь", "лом", "руда", "алюмини", "медь", "никель", "цинк",
    "steel", "metal", "scrap", "ore", "aluminum", "copper", "nickel", "zinc",
]

# ---- fixed values: topic score of a URL ------------------------------------
TOPIC_WEIGHTS = {
    "металлург": 30, "metallurg": 30, "steel": 30, "сталь": 30,
    "металлообработка": 28, "metalworking": 28, "mining": 28, "горнодобыча": 28,
    "scrap": 25, "лом": 25, "metal recycling": 25, "переработка металла": 25,
    "ferrous": 25, "черные металлы": 25, "non-ferrous": 25, "цветные металлы": 25,
    "metalinfo": 30, "metaltorg": 30, "steelland": 30,
    "aluminum": 20, "алюмини": 20, "copper": 20, "медь": 20, "iron": 20, "железо": 20,
    "zinc": 18, "цинк": 18, "nickel": 18, "никель": 18, "chromium": 18, "хром": 18,
    "titanium": 18, "титан": 18, "magnesium": 18, "магний": 18, "brass": 18, "латунь": 18,
    "ore": 15, "руда": 15, "commodity": 15, "сырье": 15, "alloy": 15, "сплав": 15,
    "завод": 15, "plant": 15, "комбинат": 15, "mill": 15, "foundry": 15, "литейный": 15,
    "производство": 15, "production": 15, "manufactur": 15, "metallplace": 20,
    "metal price": 12, "цена металл": 12, "metal market": 12, "рынок металл": 12,
    "metal export": 12, "экспорт металл": 12, "metal import": 12, "импорт металл": 12,
}
TOPIC_DOMAINS = [
    "metallurg.ru", "metalinfo.ru", "metallplace.ru", "steelguru.com",
    "metalbulletin.com", "mining.com", "severstal.com", "evraz.com",
    "mmk.ru", "nornickel.ru", "aluminum.org", "copper.org",
]
TOPIC_ARTICLE_PARTS = ["/news/", "/article/", "/story/", "/новости/", "/статья/"]
TOPIC_OFF_TERMS = ["politics", "политика", "sport", "спорт", "entertainment", "развлечения"]
TOPIC_THRESHOLDS = {"metallurgy_focused": 10, "newsapi": 15, "business_news": 15, "general": 20, "rss": 12}
TOPIC_THRESHOLDS_PERMISSIVE = {"metallurgy_focused": 8, "newsapi": 12, "business_news": 12, "general": 15, "rss": 8}
TOPIC_DEFAULT_THRESHOLD = 15
TOPIC_REQUIRED = [
    "металл", "metal", "сталь", "steel", "лом", "scrap",
    "алюмини", "aluminum", "медь", "copper", "железо", "iron",
    "metallurg", "металлург", "mining", "горнодобыча", "commodity", "сырье",
    "ore", "руда", "завод", "plant", "производство", "production",
]
TOPIC_REQUIRED_PERMISSIVE = [
    "металл", "metal", "сталь", "steel", "лом", "scrap",
    "алюмини", "aluminum", "медь", "copper", "железо", "iron",
    "metallurg", "металлург", "mining", "горнодобыча", "commodity",
    "производство", "production", "завод", "plant", "сырье", "raw",
]

# ---- fixed values: language keywords and article categories ----------------
LANGUAGE_KEYWORDS = {
    "ru": [
        "металлург", "сталь", "алюмини", "медь", "железо", "лом", "утиль",
        "переработка", "производство", "завод", "комбинат", "цена", "рынок",
        "экспорт", "импорт", "торговля", "сырье", "ресурс",
    ],
    "en": [
        "metallurg", "steel", "aluminum", "copper", "iron", "scrap", "recycling",
        "production", "plant", "mill", "price", "market", "export", "import",
        "trade", "raw materials", "resources",
    ],
    "zh": [
        "冶金", "钢", "铝", "铜", "铁", "废金属", "回收",
        "生产", "工厂", "价格", "市场", "出口", "进口",
        "贸易", "原材料", "资源",
    ],
}
CATEGORY_MATERIALS = {
    "ferrous": [
        "ферросплав", "черный металл", "железо", "сталь", "чугун",
        "ferrous", "iron", "steel", "cast iron", "pig iron",
    ],
    "non_ferrous": [
        "цветной металл", "алюмини", "медь", "цинк", "никель", "свинец",
        "non-ferrous", "aluminum", "copper", "zinc", "nickel", "lead",
    ],
    "precious": [
        "драгоценный", "золото", "серебро", "платина", "палладий",
        "precious", "gold", "silver", "platinum", "palladium",
    ],
    "scrap": [
        "лом", "утиль", "scrap", "waste", "recycling", "переработка",
        "вторичный", "secondary", "metal waste",
    ],
}
CATEGORY_REGIONS = {
    "russia": [
        "россия", "российск", "москва", "санкт-петербург", "екатеринбург",
        "новолипецк", "магнитогорск", "череповец", "нижний новгород",
        "russia", "russian", "moscow", "st. petersburg", "yekaterinburg",
    ],
    "europe": [
        "европа", "европейск", "германия", "франция", "великобритания",
        "италия", "испания", "польша", "украина", "беларусь",
        "europe", "european", "germany", "france", "uk", "italy", "spain",
    ],
    "asia": [
        "азия", "азиатск", "китай", "япония", "корея", "индия",
        "asia", "asian", "china", "japan", "korea", "india",
    ],
    "america": [
        "америка", "сша", "соединенные штаты", "канада", "бразилия",
        "america", "usa", "united states", "canada", "brazil",
    ],
}
CATEGORY_NEWS_TYPES = {
    "prices": [
        "цена", "стоимость", "рынок", "торги", "котировки", "валюта",
        "price", "cost", "market", "trading", "quotes", "currency",
    ],
    "production": [
        "производство", "выпуск", "завод", "комбинат", "предприятие",
        "production", "output", "plant", "mill", "facility",
    ],
    "trade": [
        "торговля", "экспорт", "импорт", "поставки", "контракт",
        "trade", "export", "import", "supply", "contract",
    ],
    "policy": [
        "политика", "закон", "регулирование", "министерство", "правительство",
        "policy", "law", "regulation", "ministry", "government",
    ],
    "technology": [
        "технология", "инновации", "оборудование", "модернизация",
        "technology", "innovation", "equipment", "modernization",
    ],
    "environment": [
        "экология", "окружающая среда", "загрязнение", "эко",
        "environment", "pollution", "eco", "green",
    ],
    "market_analysis": [
        "анализ", "прогноз", "тенденции", "статистика", "отчет",
        "analysis", "forecast", "trends", "statistics", "report",
    ],
    "logistics": [
        "логистика", "транспорт", "доставка", "поставки", "склад",
        "logistics", "transport", "delivery", "supply", "warehouse",
    ],
}
SUGGESTION_STOPWORDS = [
    "и", "в", "на", "с", "по", "для", "от", "до", "из", "к", "о",
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
]

# ---- fixed values: search terms and places ---------------------------------
SEARCH_TERMS = [
    "scrap metal recycling center", "scrap yard", "metal recycling services",
    "scrap metal buyers", "scrap metal collection",
]
SEARCH_TERM_PREFIXES = ["metal recycling", "scrap yard near", "sell scrap metal", "scrap prices"]
DIRECTORY_QUERY_PREFIXES = [
    "site:yelp.com scrap metal recycling", "site:yellowpages.com scrap metal",
    "site:superpages.com metal recycling", "site:merchantcircle.com scrap yard",
    "site:cylex-usa.com metal recycling", "scrap metal recycling directory",
    "metal recycling companies list", "scrap yard directory",
]
# {loc} = "City, State" encoded, {city} / {state} encoded, {state_lower} lower-cased
DIRECTORY_URL_TEMPLATES = [
    "https://www.yelp.com/search?find_desc=scrap+metal+recycling&find_loc={loc}",
    "https://www.yelp.com/search?find_desc=metal+salvage+yard&find_loc={loc}",
    "https://www.yelp.com/search?find_desc=auto+salvage&find_loc={loc}",
    "https://www.yellowpages.com/search?search_terms=scrap+metal+recycling&geo_location_terms={loc}",
    "https://www.yellowpages.com/search?search_terms=metal+recycling&geo_location_terms={loc}",
    "https://www.yellowpages.com/search?search_terms=junkyard&geo_location_terms={loc}",
    "https://www.manta.com/search?search=scrap+metal+recycling+{loc}",
    "https://www.bizapedia.com/search?q=metal+recycling+{city}+{state}",
    "https://www.brownbook.net/search?where={loc}&what=scrap+metal+recycling",
    "https://www.scrapmonster.com/directory/scrap-dealers/{state_lower}",
    "https://www.recyclenet.org/directory/{state_lower}",
    "https://www.wasteadvantage.com/directory/recycling/{state_lower}",
]
MAJOR_CITIES = {
    "California": ["Los Angeles", "San Francisco", "San Diego", "Sacramento", "San Jose", "Fresno", "Long Beach", "Oakland", "Bakersfield", "Anaheim"],
    "Texas": ["Houston", "Dallas", "San Antonio", "Austin", "Fort Worth", "El Paso", "Arlington", "Corpus Christi", "Plano", "Lubbock"],
    "New York": ["New York", "Buffalo", "Rochester", "Yonkers", "Syracuse", "Albany", "New Rochelle", "Mount Vernon", "Schenectady", "Utica"],
    "Florida": ["Jacksonville", "Miami", "Tampa", "Orlando", "St. Petersburg", "Hialeah", "Tallahassee", "Fort Lauderdale", "Port St. Lucie", "Cape Coral"],
    "Illinois": ["Chicago", "Aurora", "Rockford", "Joliet", "Naperville", "Springfield", "Peoria", "Elgin", "Waukegan", "Cicero"],
    "Pennsylvania": ["Philadelphia", "Pittsburgh", "Allentown", "Erie", "Reading", "Scranton", "Bethlehem", "Lancaster", "Harrisburg", "Altoona"],
    "Ohio": ["Columbus", "Cleveland", "Cincinnati", "Toledo", "Akron", "Dayton", "Parma", "Canton", "Youngstown", "Lorain"],
    "Georgia": ["Atlanta", "Augusta", "Columbus", "Savannah", "Athens", "Sandy Springs", "Roswell", "Macon", "Johns Creek", "Albany"],
    "North Carolina": ["Charlotte", "Raleigh", "Greensboro", "Durham", "Winston-Salem", "Fayetteville", "Cary", "Wilmington", "High Point", "Asheville"],
    "Michigan": ["Detroit", "Grand Rapids", "Warren", "Sterling Heights", "Lansing", "Ann Arbor", "Flint", "Dearborn", "Livonia", "Westland"],
}
STATE_NEIGHBOURS = {
    "California": ["Nevada", "Arizona", "Oregon"],
    "Texas": ["Oklahoma", "Arkansas", "Louisiana", "New Mexico"],
    "New York": ["New Jersey", "Connecticut", "Pennsylvania", "Massachusetts"],
    "Florida": ["Georgia", "Alabama"],
    "Illinois": ["Indiana", "Wisconsin", "Iowa", "Missouri"],
    "Pennsylvania": ["New York", "New Jersey", "Ohio", "West Virginia", "Maryland"],
}
PRIORITY_CAPS = {1: 20, 2: 15, 3: 10}
PRIORITY_CAP_DEFAULT = 5
US_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA",
    "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]
COUNTRY_REGION_CODES = {
    "united states": "US", "usa": "US", "us": "US", "canada": "CA",
    "united kingdom": "GB", "uk": "GB", "australia": "AU",
    "new zealand": "NZ", "ireland": "IE", "india": "IN", "south africa": "ZA",
}
REGION_CALLING_CODES = {
    "US": "1", "CA": "1", "GB": "44", "AU": "61", "NZ": "64", "IE": "353", "IN": "91", "ZA": "27",
}

# ---- fixed values: materials, services, attributes -------------------------
MATERIAL_KEYWORDS = [
    "copper", "aluminum", "aluminium", "steel", "stainless", "iron", "brass",
    "lead", "zinc", "nickel", "battery", "catalytic", "catalytic converter",
    "cable", "wire", "radiator", "bronze", "carbide", "titanium", "magnesium",
]
VALID_MATERIALS = [
    "copper", "aluminum", "aluminium", "steel", "stainless", "iron", "brass",
    "lead", "zinc", "nickel", "battery", "catalytic", "cable", "wire",
    "radiator", "bronze", "carbide", "titanium", "magnesium", "scrap",
    "metal", "auto", "car", "appliance", "construction",
]
METAL_TYPES = {
    "copper": ["copper", "медь", "cu", "bare copper", "copper wire", "copper tubing"],
    "aluminum": ["aluminum", "aluminium", "алюминий", "al", "aluminum cans", "aluminum siding"],
    "steel": ["steel", "сталь", "iron", "железо", "scrap steel", "structural steel"],
    "brass": ["brass", "латунь", "yellow brass", "red brass", "brass fittings"],
    "stainless_steel": ["stainless steel", "нержавейка", "stainless", "ss"],
    "lead": ["lead", "свинец", "pb", "lead batteries", "lead pipes"],
    "zinc": ["zinc", "цинк", "zn", "galvanized"],
    "nickel": ["nickel", "никель", "ni", "nickel alloy"],
    "tin": ["tin", "олово", "sn"],
    "carbide": ["carbide", "карбид", "tungsten carbide", "cutting tools"],
    "precious_metals": ["gold", "silver", "platinum", "palladium", "rhodium"],
    "electronic": ["electronics", "e-waste", "circuit boards", "computer scrap", "cell phones"],
    "automotive": ["catalytic converters", "car batteries", "radiators", "engines"],
    "wire": ["wire", "провода", "cable", "insulated wire", "romex wire"],
    "cast_iron": ["cast iron", "чугун", "cast", "machine parts"],
    "titanium": ["titanium", "титан", "ti", "aerospace grade"],
}
SERVICES = [
    "pickup service", "container rental", "demolition", "roll-off containers",
    "processing", "sorting", "weighing", "cash payment", "check payment",
    "industrial cleanup", "auto dismantling", "certified scales",
    "commercial accounts", "residential pickup", "same day pickup",
]
SERVICE_PHRASES = [
    r"we\s+(?:offer|provide|do)\s+([^.]+)",
    r"services?\s*:?\s*([^.]+)",
    r"specializ(?:e|ing)\s+in\s+([^.]+)",
    r"(?:pickup|collection|removal)\s+service",
    r"(?:container|dumpster|roll-off)\s+rental",
    r"(?:demolition|dismantling)\s+service",
]
PRICE_PATTERNS = [
    r"\$\s?\d+(?:\.\d+)?\s?(?:/|per)\s?(?:lb|pound|kg|kilogram)",
    r"\d+(?:\.\d+)?\s?(?:USD|CAD|GBP|EUR)\s?(?:/|per)\s?(?:lb|pound|kg|kilogram)",
]
# (pattern, metal group, price group, unit group); 0 = not captured
PRICE_STRUCT_PATTERNS = [
    (r"(\w+)\s*\$?(\d+\.?\d*)\s*(lb|pound|ton|per\s*pound)", 1, 2, 3),
    (r"\$(\d+\.?\d*)\s*(per\s*pound|/\s*lb|per\s*ton)", 0, 1, 2),
    (r"(\d+\.?\d*)\s*cents?\s*(per\s*pound|/\s*lb)", 0, 1, 2),
    (r"paying\s*\$?(\d+\.?\d*)\s*(per\s*pound|/\s*lb)", 0, 1, 2),
    (r"(copper|aluminum|steel|brass|iron)\s*\$?(\d+\.?\d*)", 1, 2, 0),
]
PAYMENT_KEYWORDS = [
    "cash", "check", "credit card", "debit card", "visa", "mastercard",
    "american express", "discover", "paypal", "wire transfer",
    "bank transfer", "financing", "net terms",
]
PAYMENT_GROUPS = [
    ("Cash", ["cash"]),
    ("Check", ["check", "cheque"]),
    ("Credit Card", ["credit", "card", "visa", "mastercard"]),
    ("Bank Transfer", ["wire", "ach", "bank"]),
]
CERTIFICATION_PATTERNS = [
    r"ISO\s*\d{4,5}", r"R2\s*certified", r"EPA\s*registered", r"ISRI\s*member",
    r"certified\s+\w+", r"licensed\s+\w+", r"OSHA\s*compliant",
]
CERTIFICATION_FLAGS = [
    ("ISO Certified", ["iso"]), ("EPA Compliant", ["epa"]), ("OSHA Compliant", ["osha"]),
    ("R2 Certified", ["r2"]), ("Industry Certified", ["certified", "licensed", "registered"]),
]
YEARS_PATTERNS = [
    r"(\d{1,2})\s*\+?\s*years?\s+(?:in\s+)?business",
    r"established\s+(?:in\s+)?(\d{4})",
    r"since\s+(\d{4})",
    r"founded\s+(?:in\s+)?(\d{4})",
    r"serving\s+(?:for\s+)?(\d{1,2})\s*years?",
]
LANGUAGE_PATTERNS = [
    (r"languages?\s*:?\s*([^.]+)", 1),
    (r"(?:we\s+)?speak\s+([^.]+)", 1),
    (r"bilingual\s+([^.]+)", 1),
    (r"(?:english|spanish|french|german|italian|chinese|korean|japanese|arabic|russian)", 0),
]
ADDITIONAL_INFO_PATTERNS = [
    r"(?:we\s+also|additionally|other\s+services)\s*:?\s*([^.]+)",
    r"specializing\s+in\s+([^.]+)",
    r"expertise\s+in\s+([^.]+)",
    r"focus\s+on\s+([^.]+)",
]
HOURS_TEXT_PATTERNS = [
    r"mon.*?fri.*?\d{1,2}:\d{2}.*?\d{1,2}:\d{2}",
    r"monday.*?friday.*?\d{1,2}:\d{2}.*?\d{1,2}:\d{2}",
    r"hours.*?\d{1,2}:\d{2}.*?\d{1,2}:\d{2}",
    r"open.*?\d{1,2}:\d{2}.*?\d{1,2}:\d{2}",
]
HOURS_LABELS = [
    "opening hours", "hours", "business hours", "hours of operation",
    "working hours", "open", "schedule",
]
DAY_PREFIXES = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
DAY_NAMES = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
NAME_ARTIFACTS = [
    "Home Page", "Homepage", "Welcome to", "About Us", "Contact Us",
    "Privacy Policy", "Terms of Service", "Site Map", "Sitemap",
]
SOCIAL_PATTERNS = {
    "facebook": [r"facebook\.com/[^\s<>\"']+", r"fb\.com/[^\s<>\"']+", r"fb\.me/[^\s<>\"']+", r"m\.facebook\.com/[^\s<>\"']+"],
    "twitter": [r"twitter\.com/[^\s<>\"']+", r"x\.com/[^\s<>\"']+", r"t\.co/[^\s<>\"']+", r"mobile\.twitter\.com/[^\s<>\"']+"],
    "instagram": [r"instagram\.com/[^\s<>\"']+", r"instagr\.am/[^\s<>\"']+"],
    "linkedin": [r"linkedin\.com/[^\s<>\"']+", r"lnkd\.in/[^\s<>\"']+"],
    "whatsapp": [r"wa\.me/[^\s<>\"']+", r"whatsapp\.com/[^\s<>\"']+", r"api\.whatsapp\.com/[^\s<>\"']+", r"chat\.whatsapp\.com/[^\s<>\"']+", r"web\.whatsapp\.com/[^\s<>\"']+"],
    "telegram": [r"t\.me/[^\s<>\"']+", r"telegram\.me/[^\s<>\"']+", r"telegram\.org/[^\s<>\"']+", r"tg://[^\s<>\"']+"],
}

# ---- fixed values: contacts ------------------------------------------------
EMAIL_FULL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}$"
EMAIL_SPAM_WORDS = ["noreply", "donotreply", "no-reply", "example.com"]
EMAIL_EXCLUDE_SUBSTRINGS = [
    "example.com", "test.com", "google.com", "facebook.com",
    "twitter.com", "linkedin.com", "youtube.com", "instagram.com",
]
EMAIL_TEST_DOMAINS = [
    "example.com", "test.com", "sample.com", "demo.com",
    "placeholder.com", "dummy.com", "fake.com",
]
EMAIL_FIRST_SKIP = ["example.com", "test.com", "sample.com", "placeholder.com"]
PHONE_INVALID_AREAS = [
    "000", "111", "222", "333", "444", "555", "666", "777", "888", "999",
    "123", "321", "456", "654", "789", "987",
    "800", "833", "844", "855", "866", "877", "888",
]
PHONE_FAKE_NUMBERS = [
    "1234567890", "0123456789", "9876543210", "1111111111", "0000000000", "2222222222",
]
FAKE_AREA_CODES = ["555", "000", "999", "123"]
FAKE_ZIPS = [
    "00000", "11111", "22222", "33333", "44444", "55555", "66666", "77777", "88888", "99999", "12345",
]
PHONE_TAG_KEYS = [
    "phone", "contact:phone", "telephone", "contact:telephone",
    "phone:mobile", "contact:mobile", "fax", "contact:fax",
]
STREET_SUFFIXES = "Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd|Way|Court|Ct|Place|Pl|Highway|Hwy"
CITY_STOP_WORDS = [
    "on", "in", "at", "the", "and", "or", "but", "if", "to", "of", "for", "with", "by",
    "re", "et", "us", "so", "no", "go", "do", "be", "we", "he", "me", "it",
]

# ---- fixed values: relevance and validation --------------------------------
RELEVANT_BUSINESS_WORDS = [
    "scrap", "metal", "recycling", "salvage", "junk", "yard",
    "steel", "copper", "aluminum", "iron", "brass", "buyer",
    "dealer", "processing", "facility", "center", "company",
    "auto parts", "demolition", "waste", "materials",
]
RELEVANT_DENY_DOMAINS = [
    "wikipedia.org", "facebook.com", "youtube.com", "linkedin.com",
    "indeed.com", "glassdoor.com", "amazon.com", "ebay.com",
    "craigslist.org", "reddit.com", "twitter.com", "instagram.com",
]
RELEVANT_DENY_WORDS = [
    "software", "app", "game", "news", "blog", "jobs", "career",
    "hiring", "employment", "resume", "salary", "review", "rating",
    "price guide", "calculator", "directory", "listing",
]
BUSINESS_INDICATORS = [
    "llc", "inc", "corp", "company", "co.", "ltd", "phone",
    "contact", "address", "location", "hours", "service",
]
WEAK_RELEVANT_WORDS = [
    "scrap", "metal", "recycling", "salvage", "junk", "yard",
    "steel", "copper", "aluminum", "brass", "iron", "auto",
    "buyer", "dealer", "pickup", "demolition",
]
WEAK_DENY_WORDS = [
    "software", "app", "game", "music", "movie", "book",
    "news", "blog", "wikipedia", "facebook", "linkedin",
]
MIN_REQUIREMENT_WORDS = ["scrap", "metal", "recycling", "salvage", "steel", "aluminum", "copper", "iron", "brass"]
PLACEHOLDER_WORDS = ["example", "sample", "test", "dummy", "placeholder"]
SYNTHETIC_WORDS = [
    "example", "sample", "test", "demo", "placeholder",
    "lorem", "ipsum", "abc company", "xyz corp", "company name", "business name",
]
BASIC_TOPIC_WORDS = [
    "scrap", "metal", "recycling", "salvage", "steel", "aluminum",
    "copper", "iron", "auto", "junk", "waste", "demolition",
]
SYNTHETIC_HOUSES = ["1234", "2345", "3456", "4567", "5678", "6789"]
SYNTHETIC_PHONES = ["555-1234", "555-5678", "555-0000"]
SYNTHETIC_ENDINGS = ["1234", "5678", "0000", "1111"]
SYNTHETIC_NAMES = ["Scrap Metal #", "Metal Recycling #", "Houston Scrap 1", "Texas Metal 1"]
FINAL_NAME_DENY = ["company #", "business #", "firm #", "corp #"]

# ---- fixed values: non-target businesses (map tags) ------------------------
NON_TARGET_TYPES = [
    "restaurant", "bar", "pub", "cafe", "food", "tattoo",
    "salon", "gym", "fitness", "hotel", "motel", "retail",
    "clothing", "electronics", "computer", "phone", "mobile",
    "bank", "insurance", "real_estate", "office", "medical",
    "dental", "veterinary", "school", "education", "church",
    "gas_station", "fuel", "convenience", "grocery", "pharmacy",
]
NON_TARGET_NAMES = [
    "restaurant", "bar", "grill", "kitchen", "cafe", "coffee",
    "tattoo", "ink", "salon", "spa", "gym", "fitness", "hotel",
    "motel", "inn", "lodge", "retail", "store", "shop", "mart",
    "bank", "credit", "insurance", "real estate", "office",
    "medical", "dental", "clinic", "hospital", "school",
    "university", "college", "church", "temple", "mosque",
    "gas station", "fuel", "convenience", "grocery", "pharmacy",
    "electronics", "computer", "phone", "mobile", "clothing",
    "fashion", "jewelry", "watch", "game", "toy", "book",
]
TARGET_NAMES = [
    "scrap", "metal", "recycling", "salvage", "junk", "auto parts",
    "steel", "iron", "aluminum", "copper", "brass", "waste management",
]
TAG_METALS = [
    ("steel", ["Steel"]), ("iron", ["Iron"]), ("aluminum", ["Aluminum"]),
    ("aluminium", ["Aluminum"]), ("copper", ["Copper"]), ("brass", ["Brass"]),
    ("bronze", ["Bronze"]), ("stainless", ["Stainless Steel"]),
    ("scrap", ["Steel", "Iron", "Aluminum"]),
    ("metal", ["Steel", "Iron", "Aluminum", "Copper"]),
]
TAG_RECYCLING_METALS = [
    ("metal", ["Steel", "Iron", "Aluminum"]), ("aluminium", ["Aluminum"]),
    ("aluminum", ["Aluminum"]), ("copper", ["Copper"]), ("steel", ["Steel"]), ("iron", ["Iron"]),
]
TAG_SERVICES = [
    ("service:pickup", "Pickup Service"), ("service:container", "Container Rental"),
    ("service:processing", "Metal Processing"), ("service:weighing", "Certified Scales"),
]
TAG_SERVICE_WORDS = [
    ("pickup", "Pickup Service"), ("container", "Container Rental"),
    ("processing", "Metal Processing"), ("scale", "Certified Scales"),
    ("weighing", "Certified Scales"), ("demolition", "Demolition Services"),
    ("cash", "Cash Payment"), ("commercial", "Commercial Accounts"),
]

# ---- fixed values: business profile ----------------------------------------
MAJOR_METROS = [
    "new york", "los angeles", "chicago", "houston", "phoenix",
    "philadelphia", "san antonio", "san diego", "dallas", "san jose",
]
MAJOR_STATES = ["CA", "TX", "NY", "FL", "IL", "PA", "OH", "GA", "NC", "MI"]
HIGH_COMPETITION_CITIES = ["chicago", "detroit", "houston", "los angeles", "philadelphia", "pittsburgh"]
HIGH_COMPETITION_STATES = ["OH", "PA", "MI", "IN", "IL"]
MEDIUM_COMPETITION_STATES = ["TX", "CA", "NY", "FL"]

COMPLETENESS_FIELDS_15 = [
    "name", "phone_primary", "address_full", "city", "country",
    "email_primary", "website", "working_hours", "materials",
    "latitude", "longitude", "description", "business_type",
    "phone_secondary", "social_media",
]
COMPLETENESS_FIELDS_10 = [
    "name", "address", "city", "state", "latitude", "longitude",
    "phone", "website", "metal_types", "services",
]
COMPLETENESS_FIELDS_11 = [
    "name", "phone", "email", "website", "address", "city", "state",
    "description", "materials_accepted", "services", "working_hours",
]
ESSENTIAL_COLUMNS = [
    "name", "address", "city", "state", "zip_code", "latitude", "longitude",
    "phone", "email", "website", "primary_metal_types", "services_offered",
]
CONTENT_SELECTORS = [
    "article", ".article-content", ".post-content", ".entry-content",
    ".content", "#content", ".main-content", ".article-body",
    '[data-testid="article-body"]', ".story-body", ".article-text",
]
DROP_TAGS = ["script", "style", "nav", "header", "footer", "aside"]
CONTENT_TAGS = ["h1", "h2", "h3", "h4", "span", "div", "p", "a", "strong"]
MIN_ARTICLE_LENGTH = 100
JSON_LD_TYPES = ["localbusiness", "organization", "recyclingcenter"]
