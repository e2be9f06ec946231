"""Small configuration tables: domains, terms, topics and labels.

Every list here is a default for a function parameter; none of them grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: source domains with their category, in list order -------------------------------
CATEGORY_DOMAINS = {
    "advertising and commercial": [
        "adweek.com", "adage.com", "thedrum.com", "campaignlive.com", "markedsforing.dk", "bureaubiz.dk",
    ],
    "journalism, news and media": [
        "reuters.com", "bbc.com", "theguardian.com", "cnn.com", "washingtonpost.com", "npr.org", "nbcnews.com",
        "abcnews.go.com", "cbsnews.com", "msnbc.com", "foxnews.com", "usatoday.com", "latimes.com",
        "theglobeandmail.com", "nationalpost.com", "cjr.org", "niemanlab.org", "poynter.org", "pressgazette.co.uk",
        "journalisten.dk", "dr.dk", "tv2.dk", "berlingske.dk", "jyllands-posten.dk", "ekstrabladet.dk", "bt.dk",
        "information.dk", "weekendavisen.dk", "kristeligt-dagblad.dk", "kforum.dk", "medietrends.dk",
        "mediawatch.dk", "politiken.dk", "arbejderen.dk", "avisen.dk", "nordjyske.dk", "sn.dk", "fyens.dk",
    ],
    "graphic design and visual communication": [
        "creativereview.co.uk", "commarts.com", "itsnicethat.com", "eyeondesign.aiga.org",
    ],
    "strategic communication and PR": [
        "prweek.com", "provokemedia.com", "prdaily.com",
    ],
    "film and TV production": [
        "variety.com", "hollywoodreporter.com", "indiewire.com", "deadline.com", "ekkofilm.dk",
    ],
    "photography": [
        "nationalgeographic.com", "bjp-online.com", "petapixel.com", "lensculture.com", "digitalfoto.dk",
    ],
    "web and UX design": [
        "smashingmagazine.com", "alistapart.com", "uxmag.com", "nngroup.com",
    ],
    "digital media and content creation": [
        "soundvenue.dk", "ddc.dk", "theverge.com", "wired.com", "mashable.com", "digiday.com",
        "contentmarketinginstitute.com", "computerworld.dk", "version2.dk", "elektronista.dk",
    ],
}
PROBLEMATIC_DOMAINS = [
    "youtube.com", "vimeo.com", "dailymotion.com", "twitch.tv", "tiktok.com", "facebook.com", "twitter.com",
    "instagram.com", "deperu.com",
]
JAPANESE_DOMAINS = [
    "jp.reuters.com", "jp.bloomberg.com", "asahi.com", "mainichi.jp", "yomiuri.co.jp",
]
ACCEPTED_LANGUAGES = [
    "en", "da", "danish", "eng", "dan", "English", "Danish",
]
# ---- end of fixed values ---------------------------------------------------------------------------

DOMAIN_CATEGORY = [(d, c) for c, names in CATEGORY_DOMAINS.items() for d in names]
RELIABLE_DOMAINS = [d for d, _ in DOMAIN_CATEGORY]
DANISH_DOMAINS = [d for d in RELIABLE_DOMAINS if d.endswith(".dk")]

# ---- fixed values: classifier terms, indicator words and topics, in list order ----------------------
CORE_TERMS = [
    "artificial intelligence", "machine learning", "deep learning", "neural network", "openai", "chatgpt", "gpt-4",
    "gpt4", "claude", "transformer", "llm", "large language model", "natural language processing", "computer vision",
    "generative ai", "ai model", "ai system", "ai research", "ai technology",
]
KEYWORD_TERMS = [
    "artificial intelligence", "machine learning", "deep learning", "neural network", "openai", "chatgpt", "gpt",
    "claude", "transformer", "llm", "large language model", "natural language processing", "computer vision",
    "generative ai", "ai model", "ai system",
]
LANGUAGE_MODEL_TERMS = ["chatgpt", "gpt", "claude", "llm"]
INDUSTRY_TERMS = ["openai", "anthropic"]
POSITIVE_WORDS = ["true", "yes", "ai-related", "artificial intelligence", "primarily about ai"]
TOPICS = [
    "AI Research and Development",
    "AI Ethics and Regulations",
    "AI Safety and Governance",
    "AI Business and Industry",
    "AI Language Models and NLP",
    "AI Robotics and Automation",
    "AI Healthcare and Medical",
    "AI Education and Training",
    "AI Cybersecurity and Privacy",
    "AI Computer Vision",
    "AI Data Science and Analytics",
    "AI Neural Networks and Deep Learning",
    "AI Applications and Deployment",
    "AI Technology and Infrastructure",
]
DEFAULT_TOPIC = "AI Technology and Infrastructure"
EMPTY_TOPICS = ["unknown", "unknown topic", "none", "null", "other"]
EXPLANATION_PREFIX = "OpenAI: "
# ---- end of fixed values ---------------------------------------------------------------------------

TOPIC_RULES = [("AI Language Models and NLP", LANGUAGE_MODEL_TERMS), ("AI Business and Industry", INDUSTRY_TERMS)]

# ---- fixed values: display labels, (value, English, Danish) -----------------------------------------
TOPIC_LABELS = [
    ("AI Research and Development", "Research and Development", "Forskning og udvikling"),
    ("AI Ethics and Regulations", "Ethics and Regulations", "Etik og regulering"),
    ("AI Safety and Governance", "Safety and Governance", "Sikkerhed og styring"),
    ("AI Business and Industry", "Business and Industry", "Forretning og industri"),
    ("AI Language Models and NLP", "Language Models and NLP", "Sprogmodeller og NLP"),
    ("AI Robotics and Automation", "Robotics and Automation", "Robotik og automatisering"),
    ("AI Healthcare and Medical", "Healthcare and Medical", "Sundhed og medicin"),
    ("AI Education and Training", "Education and Training", "Uddannelse og træning"),
    ("AI Cybersecurity and Privacy", "Cybersecurity and Privacy", "Cybersikkerhed og privatliv"),
    ("AI Computer Vision", "Computer Vision", "Computervision"),
    ("AI Data Science and Analytics", "Data Science and Analytics", "Datavidenskab og analyse"),
    ("AI Neural Networks and Deep Learning", "Neural Networks and Deep Learning", "Neurale netværk og deep learning"),
    ("AI Applications and Deployment", "Applications and Deployment", "Applikationer og implementering"),
    ("AI Technology and Infrastructure", "Technology and Infrastructure", "Teknologi og infrastruktur"),
]
CATEGORY_LABELS = [
    ("advertising and commercial", "Advertising and Commercial", "Reklame og markedsføring"),
    ("journalism, news and media", "Journalism, News and Media", "Journalistik, nyheder og medier"),
    ("digital media and content creation", "Digital Media and Content Creation",
     "Digitale medier og indholdsproduktion"),
    ("strategic communication and pr", "Strategic Communication and PR", "Strategisk kommunikation og PR"),
    ("photography", "Photography", "Fotografi"),
    ("web and ux design", "Web and UX Design", "Web- og UX-design"),
    ("film and tv production", "Film and TV Production", "Film- og TV-produktion"),
]
DAY_LABELS = [
    ("Monday", "Monday", "Mandag"), ("Tuesday", "Tuesday", "Tirsdag"), ("Wednesday", "Wednesday", "Onsdag"),
    ("Thursday", "Thursday", "Torsdag"), ("Friday", "Friday", "Fredag"), ("Saturday", "Saturday", "Lørdag"),
    ("Sunday", "Sunday", "Søndag"),
]
MONTH_LABELS = [
    ("January", "January", "Januar"), ("February", "February", "Februar"), ("March", "March", "Marts"),
    ("April", "April", "April"), ("May", "May", "Maj"), ("June", "June", "Juni"), ("July", "July", "Juli"),
    ("August", "August", "August"), ("September", "September", "September"), ("October", "October", "Oktober"),
    ("November", "November", "November"), ("December", "December", "December"),
]
WEEK_LABELS = [(f"Week {n}", f"Week {n}", f"Uge {n}") for n in (1, 2, 3, 4)]
OTHER_LABEL = {"en": "Other", "da": "Andet"}
# ---- end of fixed values ---------------------------------------------------------------------------

# A label the listed mapping lacks, so that this category shows under its own name instead of "Other".
EXTRA_CATEGORY_LABELS = [
    ("graphic design and visual communication", "Graphic Design and Visual Communication",
     "Grafisk design og visuel kommunikation"),
]


def domain_category_table(spark: SparkSession, rows: list[tuple[str, str]] = DOMAIN_CATEGORY) -> DataFrame:
    """`(domain, category, ord, depth)`: `ord` keeps list order, `depth` counts the labels of the domain."""
    return spark.createDataFrame(
        [(d, c, i, d.count(".") + 1) for i, (d, c) in enumerate(rows)],
        "domain STRING, category STRING, ord INT, depth INT",
    )


def label_table(spark: SparkSession, kind: str, lang: str, fix_missing: bool = False) -> DataFrame:
    """`(key, label)` for one kind of label and one language."""
    rows = {"topic": TOPIC_LABELS, "category": CATEGORY_LABELS + (EXTRA_CATEGORY_LABELS if fix_missing else []),
            "day": DAY_LABELS, "month": MONTH_LABELS, "week": WEEK_LABELS}[kind]
    return spark.createDataFrame([(key, en if lang == "en" else da) for key, en, da in rows], "key STRING, label STRING")
