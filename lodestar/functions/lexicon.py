"""Word lists, address lists and constants that results depend on."""

# Words that ranking ignores.
STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by
can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further get got had hadn't
has hasn't have haven't having he her here hers herself him himself his how i if in into is isn't it its itself just let like ll
me might more most must mustn't my myself no nor not of off on once only or other our ours ourselves out over own re s same shall
shan't she should shouldn't so some such t than that the their theirs them themselves then there these they this those through to
too under until up ve very was wasn't we were weren't what when where which while who whom why will with won't would wouldn't you
your yours yourself yourselves
""".split()

# Words that context relevance ignores.
CONTEXT_STOPWORDS = """
what is the a an of in to for and or how does do can about with from that this are was were be been being have has had will would
it its on at by but not so if than then my me we you your who which when where why all each
""".split()

# Words that are never part of an entity.
ENTITY_STOPWORDS = """
what is the a an of in to for and or how does do can about with from that this are was were be been being have has had will would
it its on at by but not so if than then my me we you your who which when where why all each tell give show find between vs versus
compared latest current recent new best top most many much very just also now today explain describe analyze
""".split()

# Query parameters that are dropped from addresses.
TRACKING = """
utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_cid fbclid gclid gclsrc dclid msclkid twclid igshid ref source
src campaign affiliate partner _ga _gl _gid mc_cid mc_eid mkt_tok amp amp_js_v usqp spm share_from scm
""".split()

# Addresses that are passed over.
SKIP_DOMAINS = """
vimeo.com twitter.com x.com facebook.com instagram.com linkedin.com pinterest.com tiktok.com play.google.com apps.apple.com
drive.google.com docs.google.com amazon.com ebay.com aliexpress.com
""".split()
SKIP_EXTENSIONS = ".zip .rar .7z .tar .gz .mp3 .mp4 .avi .mkv .mov .exe .msi .dmg .apk".split()

# Weights of search engines; others weigh 1.
ENGINE_WEIGHTS = {
    1.5: "google bing duckduckgo brave wikipedia".split(),
    1.2: "startpage qwant mojeek yahoo yandex ecosia".split(),
    0.8: "dogpile webcrawler excite wiby marginalia mwmbl stract 4get whoogle librex yacy mullvad_leta alexandria".split(),
}

# Which engines a mode asks, in order.
ENGINE_SETS = {
    "primary": "wikipedia duckduckgo brave yahoo bing google qwant startpage mojeek ecosia wiby".split(),
    "backup": """bing_news google_news brave_news yahoo_news yandex ask dogpile excite webcrawler presearch yep mwmbl marginalia stract
                 bing_us bing_uk google_us google_uk alexandria 4get whoogle librex yacy mullvad_leta""".split(),
    "tech": "duckduckgo brave google bing startpage qwant google_news bing_news marginalia stract wiby".split(),
    "science": "wikipedia google google_scholar brave duckduckgo startpage mojeek bing ecosia qwant".split(),
    "finance": "google google_news bing bing_news yahoo yahoo_news brave brave_news duckduckgo startpage".split(),
    "health": "google wikipedia bing duckduckgo brave google_scholar mojeek startpage ecosia qwant".split(),
    "news": "google_news bing_news brave_news yahoo_news duckduckgo_news google bing brave yahoo duckduckgo".split(),
    "default": "wikipedia duckduckgo brave google bing yahoo qwant startpage mojeek ecosia".split(),
}

# Words that a domain adds to a query.
DOMAIN_SUFFIXES = {"tech": "programming tutorial", "science": "research study", "finance": "market analysis", "health": "medical research", "news": "latest 2026", "default": "guide"}

# Labels of hosts, first match first.
CREDIBILITY = [
    ("wikipedia.org", "[High Trust - Wikipedia]"), ("nih.gov", "[High Trust - NIH]"), ("who.int", "[High Trust - WHO]"), ("nature.com", "[High Trust - Nature]"),
    ("sciencedirect.com", "[High Trust - ScienceDirect]"), ("arxiv.org", "[High Trust - arXiv]"), ("pubmed.ncbi", "[High Trust - PubMed]"),
    ("reddit.com", "[Forum Discussion - Reddit]"), ("stackexchange.com", "[Forum Discussion - StackExchange]"), ("stackoverflow.com", "[Forum Discussion - StackOverflow]"),
    ("quora.com", "[Forum Discussion - Quora]"), ("news.ycombinator.com", "[Forum Discussion - Hacker News]"),
    ("bbc.com", "[High Trust - News - BBC]"), ("bbc.co.uk", "[High Trust - News - BBC]"), ("reuters.com", "[High Trust - News - Reuters]"), ("apnews.com", "[High Trust - News - AP News]"),
    ("nytimes.com", "[High Trust - News - NYT]"), ("theguardian.com", "[High Trust - News - Guardian]"), ("cnn.com", "[High Trust - News - CNN]"), ("bloomberg.com", "[High Trust - News - Bloomberg]"),
    ("washingtonpost.com", "[High Trust - News - WashPost]"), ("wsj.com", "[High Trust - News - WSJ]"), ("aljazeera.com", "[High Trust - News - Al Jazeera]"), ("economist.com", "[High Trust - News - Economist]"),
    ("docs.python.org", "[High Trust - Docs - Python Docs]"), ("developer.mozilla.org", "[High Trust - Docs - MDN]"), ("docs.rust-lang.org", "[High Trust - Docs - Rust Docs]"),
    ("docs.microsoft.com", "[High Trust - Docs - MS Docs]"), ("learn.microsoft.com", "[High Trust - Docs - MS Learn]"), ("docs.github.com", "[High Trust - Docs - GitHub Docs]"),
    ("docs.aws.amazon.com", "[High Trust - Docs - AWS Docs]"), ("cloud.google.com", "[High Trust - Docs - Google Cloud]"),
    ("techcrunch.com", "[Tech News - TechCrunch]"), ("arstechnica.com", "[Tech News - ArsTechnica]"), ("theverge.com", "[Tech News - The Verge]"),
    ("wired.com", "[Tech News - Wired]"), ("zdnet.com", "[Tech News - ZDNet]"), ("engadget.com", "[Tech News - Engadget]"),
]
INSTITUTIONAL = "[High Trust - Institutional]"

# Trust of hosts, first match first; others have 1.
TRUST = [
    (1.5, "wikipedia.org nih.gov who.int nature.com sciencedirect.com arxiv.org pubmed.ncbi britannica.com plato.stanford.edu".split()),
    (1.3, "stackoverflow.com stackexchange.com github.com developer.mozilla.org docs.python.org docs.rust-lang.org docs.microsoft.com learn.microsoft.com docs.aws.amazon.com cloud.google.com docs.github.com".split()),
    (1.2, "bbc.com bbc.co.uk reuters.com apnews.com nytimes.com theguardian.com bloomberg.com washingtonpost.com wsj.com economist.com".split()),
    (1.1, "techcrunch.com arstechnica.com theverge.com wired.com zdnet.com".split()),
    (0.8, "reddit.com quora.com news.ycombinator.com".split()),
]

# What the kinds of query say.
NAVIGATION_SITES = "facebook youtube twitter reddit instagram tiktok amazon google github linkedin netflix spotify wikipedia stackoverflow gmail outlook whatsapp".split()
COMPARISON = [" vs ", " versus ", "difference between", "compared to", "comparison of"]
PERSON = ["who is", "who was", "who are", "tell me about", "biography of", "bio of", "life of", "about the person"]
HOWTO = ["how to", "how do", "how can", "how does", "how is", "step by step", "steps to", "guide to", "tutorial", "instructions for", "ways to", "tips for", "best way to", "learn to", "teach me"]
TEMPORAL = ["latest", "current", "newest", "recent", "today", "right now", "as of", "breaking", "just announced", "this year", "this week", "this month", "what is the price", "stock price", "market cap", "score of", "results of"]
ROLES = ["ceo of", "president of", "prime minister of", "leader of", "founder of", "chairman of", "director of", "head of", "worth of", "net worth", "salary of", "age of"]
RESEARCH = ["explain", "analyze", "research", "comprehensive", "in depth", "detailed", "overview of", "deep dive", "implications of", "impact of", "future of"]
RECENCY = ["latest", "current", "newest", "recent", "today", "now", "updated", "breaking", "just", "new"]
RELATIVE = ["this year", "this week", "this month", "this quarter", "yesterday", "last week", "last month", "right now", "as of"]
IMPLICIT = ["who is the", "how much is", "what is the price", "what is the score", "what is the status", "is it", "are they", "will they", "ceo of", "president of", "prime minister", "leader of", "worth of", "net worth", "stock price", "market cap", "population of"]
LIVE_RECENCY = ["latest", "current", "recent", "today", "new", "now", "this year", "right now", "as of", "updated", "newest"]
YEARS = [str(y) for y in range(2020, 2031)]
NEWS = ["news", "breaking", "announced"]

# First lines of an answer that say nothing.
PREAMBLES = [
    "based on the search results", "based on the provided sources", "based on the sources provided", "according to the search results", "according to the sources", "here is what i found", "here's what i found",
    "let me summarize", "i found the following", "from the search results", "based on my research", "here is a summary", "here's a summary",
]

# Constants of ranking and context.
RRF_K = 60.0
BM25_K1, BM25_B, BM25_DELTA = 1.2, 0.75, 1.0
PHRASE_BONUS, TITLE_BONUS, CONSENSUS, CONFIDENCE, CONFIDENCE_WEIGHT = 1.25, 0.5, 0.5, 0.7, 0.05
CHUNK_LEAST, CHUNK_MOST, OVERLAP = 80, 600, 0.15
MMR_LAMBDA, CHUNKS_PER_URL = 0.7, 3
CONTEXT_BYTES_LITE, CONTEXT_BYTES_RESEARCH, CHUNKS_LITE, BATCH = 16_000, 12_000, 30, 50
