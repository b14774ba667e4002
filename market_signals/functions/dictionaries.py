"""Default term lists and limits. Every function that uses one takes it as a parameter."""

# The lists below decide results, in this order.
THEMES = {
    "market_competition": ["auction", "cfd", "bid", "leasing round", "prequalification", "license round"],
    "procurement": ["tender", "procurement", "rfp", "framework agreement", "contract notice"],
    "funding": ["grant", "funding", "support scheme", "horizon", "subsidy"],
    "policy": ["policy", "regulation", "government", "ministry", "directive", "consultation"],
    "projects": ["project", "fids", "final investment decision", "pipeline", "capacity expansion"],
    "supply_chain": ["supply chain", "supplier", "factory", "port", "installation vessel", "fabrication"],
    "technology": ["floating", "fixed-bottom", "turbine", "substation", "foundation", "electrolyser"],
    "finance": ["financing", "investment", "bank", "equity", "debt", "ppas"],
}
CORE_THEMES = ["market_competition", "procurement", "funding", "policy"]
GEOGRAPHIES = {
    "Norway": ["norway", "norwegian"],
    "UK": ["uk", "united kingdom", "england", "scotland"],
    "EU": ["eu"],
    "Europe": ["europe"],
    "Denmark": ["denmark"],
    "Germany": ["germany"],
    "Netherlands": ["netherlands", "dutch"],
    "Sweden": ["sweden"],
    "France": ["france"],
    "Spain": ["spain"],
    "Poland": ["poland"],
    "Italy": ["italy"],
    "Japan": ["japan"],
    "South Korea": ["korea", "south korea"],
    "USA": ["usa", "united states"],
    "Canada": ["canada"],
    "Australia": ["australia"],
    "Taiwan": ["taiwan"],
}
CORE_GEOGRAPHIES = ["Norway", "UK", "EU", "Europe"]
ACTORS = ["Equinor", "RWE", "Vattenfall", "Orsted", "TotalEnergies", "BP", "Shell", "Iberdrola", "Siemens Gamesa", "Vestas", "GE Vernova", "Statkraft"]
PAYWALL = ["paywalled", "paywall", "no full access", "partial/open text", "subscriber", "subscription"]
PAGE_PAYWALL = ["subscribe", "subscriber", "subscription", "sign in", "log in", "paywall", "abonner", "abonnement"]
OFFSHORE = ["offshore wind", "offshore", "wind farm", "floating wind", "fixed-bottom", "turbine installation", "cfd auction", "lease round", "subsea cable"]
ADJACENT = ["grid", "transmission", "interconnector", "hydrogen", "electrolyser", "port", "supply chain", "battery", "renewables", "power market"]
OTHER_ENERGY = ["oil", "gas", "lng", "upstream", "drilling", "refinery", "petroleum"]
BUCKETS = ["offshore_wind", "adjacent_energy", "other_energy"]
CLUSTER_STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "its", "new", "of", "on", "or", "the", "to", "with", "offshore", "wind", "project", "projects"]
GENERIC_TITLES = ["about", "about us", "about wind", "videos", "video", "photos", "photo", "membership", "events", "event", "careers", "career", "data", "policy", "news", "latest news", "position and statements", "contact", "login", "sign in", "register", "privacy", "cookie policy", "terms"]
STATIC_PATHS = ["/about", "/membership", "/careers", "/events", "/videos", "/photos", "/contact", "/privacy", "/cookies", "/terms", "/login", "/register", "/tag/", "/category/"]
SECTIONS = ["news", "latest-news", "about", "about-us", "events", "careers", "membership", "policy", "data", "video", "videos", "photo", "photos", "category", "tag"]
HINTS = ["offshore", "wind", "auction", "tender", "project", "farm", "developer", "capacity", "floating", "cfd", "market", "supply chain", "turbine", "regulation", "policy update", "gw", "mw"]
ARTICLE_KEYS = ["id", "article", "story", "post", "p"]
FAMILIES = {
    "funding_calls": ["grant", "funding", "support scheme", "horizon", "innovation"],
    "procurement_tenders": ["tender", "procurement", "rfp", "framework agreement"],
    "market_competitions": ["auction", "leasing", "cfd", "prequalification", "round"],
    "strategic_programs": ["pilot", "demonstration", "program", "eoi", "rfi"],
}
MECHANISMS = {
    "cfd_auction": ["cfd"],
    "prequalification": ["prequalification", "pre-qualification"],
    "tender": ["tender", "rfp", "call for tender"],
    "grant": ["grant", "funding call", "subsidy"],
    "eoi_rfi": ["eoi", "rfi"],
}
PRIMARY_MARKETS = ["NOR", "DNK", "GBR"]
SECONDARY_MARKETS = ["DEU", "NLD", "SWE", "BEL", "MEX", "CHL", "COL", "IND", "AUS", "ARE", "SAU"]
TED_COUNTRIES = ["NOR", "DNK", "GBR", "DEU", "NLD", "SWE", "BEL", "IRL", "MEX", "CHL", "COL", "IND", "AUS", "SGP", "ARE", "SAU", "ZAF", "GHA"]
TED_EXCLUDED = ["CAN", "CORR", "VEAT", "BUS", "UNN"]
DOFFIN_TYPES = ["COMPETITION", "ANNOUNCEMENT_OF_COMPETITION", "PRE_ANNOUNCEMENT"]
COUNTRY_CODES = {"NO": "NOR", "DK": "DNK", "GB": "GBR", "UK": "GBR", "DE": "DEU", "NL": "NLD", "SE": "SWE", "BE": "BEL", "IE": "IRL", "US": "USA", "AU": "AUS", "MX": "MEX", "CL": "CHL", "CO": "COL", "IN": "IND", "SG": "SGP", "AE": "ARE", "SA": "SAU", "ZA": "ZAF", "GH": "GHA"}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
ANGLE = "Explain why this signal matters for offshore wind investors and supply chain players."
ACTIONS = [
    "Escalate now: prepare bid/no-bid decision and assign owner within 24h.",
    "Prepare qualification note and shortlist for bid/no-bid review this week.",
    "Run a fast capability check against matched services before deeper pursuit.",
    "Monitor this notice and reassess when more context or documents are available.",
]
#: Parts of the texts that tell why an item matters.
NEWS_WHY = ["This may influence offshore wind strategy in ", " through themes: "]
OPPORTUNITY_WHY = ["This signal indicates a ", " opportunity via ", " in ", ". Strategic fit is ", ", so it can influence near-term pipeline prioritization."]
LEAD_SUFFIXES = {"TED": "TED radar", "DOFFIN": "Doffin", "WORLDBANK": "World Bank"}
COMMON_FEED_PATHS = ["/feed", "/rss", "/rss.xml", "/feed.xml", "/atom.xml", "/service/rss"]
#: The default profiles, in order of precedence.
PROFILES = [
    {
        "company": "AGR",
        "name": "Marine Survey & Geoscience",
        "keywords": ["marine survey", "geotechnical", "geophysical", "cable route", "seabed"],
        "aliases": ["hydrographic", "UXO survey", "site investigation"],
        "qualifier": ["offshore", "subsea", "marine", "wind", "cable"],
        "negative_keywords": ["building construction", "school", "hospital", "road maintenance", "catering"],
        "cpv_codes": ["71354500", "71351914", "45111250"],
    },
    {
        "company": "MAV",
        "name": "Strategy & Advisory",
        "keywords": ["advisory", "strategy", "due diligence", "market analysis", "project development"],
        "aliases": ["transaction support", "commercial advisory"],
        "qualifier": ["offshore", "wind", "renewable", "port", "maritime"],
        "negative_keywords": ["classroom", "farming", "medical equipment", "office cleaning"],
        "cpv_codes": ["79411100", "79400000", "90713000"],
    },
]
# End of fixed values.
