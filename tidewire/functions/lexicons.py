"""Word lists and tables whose values must be these for right results: fixed values, stated as they are."""

from __future__ import annotations

RULES_VERSION = "rules-v3"
PAIR_VERSION = "semantic-v1"
SAME_DAY_VERSION = "same-day-v3"

# Terms that mark a story as about AI.
AI_KEYWORDS = (
    "ai", "artificial intelligence", "machine learning", "generative ai", "generative artificial intelligence", "large language model",
    "large language models", "llm", "llms", "ai model", "ai models", "foundation model", "foundation models", "neural network",
    "deep learning", "openai", "anthropic", "google deepmind", "google ai", "gemini", "gpt", "claude", "llama", "mistral", "deepseek",
    "hugging face", "nvidia ai", "ai agent", "ai agents", "agentic ai", "computer vision", "robotics", "multimodal", "reasoning model",
    "reasoning models",
)

# Companies and products that fact extraction knows.
COMPANIES = (
    "openai", "anthropic", "google", "google deepmind", "deepmind", "microsoft", "meta", "amazon", "aws", "nvidia", "apple", "xai",
    "mistral", "mistral ai", "hugging face", "ibm", "salesforce", "adobe", "tesla", "samsung", "intel", "qualcomm", "baidu", "alibaba",
    "tencent", "huawei", "cohere", "stability ai", "perplexity", "databricks", "scale ai", "character.ai", "inflection ai", "runway",
    "midjourney",
)
PRODUCTS = (
    "gpt-4", "gpt-4o", "gpt-5", "chatgpt", "claude", "gemini", "llama", "copilot", "dall-e", "sora", "midjourney", "stable diffusion",
    "bard", "bing chat", "gpt-3", "palm", "mistral", "mixtral", "grok", "deepseek", "qwen",
)

# Trigger words of event categories.
EVENTS = {
    "launch": ("launches", "launch", "launched", "launching", "unveils", "unveiled", "unveiling", "releases", "released", "releasing", "debuts", "debuted", "debuting"),
    "funding": ("raises", "raised", "raising", "funding", "series a", "series b", "series c", "series d", "series e", "valuation", "investment"),
    "acquisition": ("acquires", "acquired", "acquiring", "acquisition", "buys", "buying", "bought", "merger"),
    "lawsuit_regulatory": ("lawsuit", "sues", "sued", "suing", "antitrust", "regulator", "ban", "banned", "fined", "investigation"),
    "research": ("paper", "study", "research", "benchmark"),
    "partnership": ("partners with", "partnered with", "partnership", "collaborates", "collaborated", "collaboration"),
    "personnel": ("hires", "hired", "hiring", "resigns", "resigned", "steps down", "stepped down", "appointed", "fired", "layoffs"),
    "safety_policy": ("safety", "ai policy", "ai regulation", "regulatory", "guardrails", "alignment"),
}

# Categories by event, first match first.
CATEGORY_OF_EVENT = (
    ("research", "research"), ("lawsuit_regulatory", "security_policy"), ("safety_policy", "security_policy"), ("funding", "business"),
    ("acquisition", "business"), ("partnership", "business"), ("personnel", "business"),
)
COMMUNITY_PREFIXES = ("show hn:", "launch hn:", "ask hn:")

# Credibility of sources, other names of theirs, and weights of the score.
CREDIBILITY = {
    "OpenAI": 0.95, "Google AI": 0.95, "NVIDIA Blog": 0.90, "Microsoft Research Blog": 0.90, "MIT Technology Review AI": 0.90,
    "Hugging Face Blog": 0.85, "The Verge AI": 0.85, "Ars Technica AI": 0.85, "TechCrunch AI": 0.80, "VentureBeat AI": 0.75,
    "Google DeepMind News": 0.95, "Wired — Artificial Intelligence": 0.85, "Hacker News": 0.75, "The Guardian": 0.85, "The Register": 0.80,
    "MacRumors": 0.75, "IEEE Spectrum": 0.90, "Google Research Blog": 0.90, "Amazon Science": 0.90, "Berkeley AI Research (BAIR)": 0.90,
}
CREDIBILITY_ALIASES = {"The Guardian AI": "The Guardian", "IEEE Spectrum — Artificial Intelligence": "IEEE Spectrum"}
DEFAULT_CREDIBILITY, PRIMARY_CREDIBILITY = 0.60, 0.85
MOMENTUM_CAP = 3
SCORE_WEIGHTS = {"recency": 0.35, "credibility": 0.25, "ai_relevance": 0.25, "momentum": 0.15}
VERIFICATION_BONUS = 0.05
RECENCY_HOURS, DEDUP_HOURS = 22, 48
PRIMARY_SLOTS, BACKUP_SLOTS = 25, 5
TITLE_SEQUENCE, TITLE_JACCARD = 0.55, 0.35

# Types of development that stand alone, and those of one product's life.
DISTINCT_TYPES = ("pricing", "funding", "acquisition", "partnership", "security", "lawsuit", "policy", "personnel", "shutdown", "research", "benchmark")
LIFECYCLE_TYPES = ("launch", "feature", "update", "availability", "expansion")

# Words that are no names, company names as single words, and words that only fill such names.
NO_ENTITIES = tuple(
    "the this that these those a an in on at for to of and or but as by with from it its is are was were how why what when where who which will can new now today here there his her their our "
    "your my we you they he she i if so after before over under more most all one two three also not no yes just about into than then some any every each other inside report reports says said "
    "say monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december ai ceo cto api us uk eu app apps llm llms "
    "gpu gpus ml it's faq update updates exclusive breaking opinion analysis watch review ask show hn tell u.s u.s. ap inc ltd corp co pm am".split()
)
COMPANY_TOKENS = tuple(
    sorted(
        {w for name in COMPANIES for w in name.split()}
        | set(
            "apple xai openai anthropic google microsoft meta amazon nvidia tesla samsung sony oracle uber spotify netflix disney intel amd huawei bytedance tiktok snap pinterest reddit x twitter github "
            "linkedin paypal stripe shopify cloudflare palantir deepmind mozilla cursor figma notion slack zoom siri".split()
        )
    )
)
COMPANY_FILLER = ("ai", "labs", "research", "blog", "news", "hugging", "face", "scale", "character")

# Terms too general to tell stories apart.
GENERIC_TERMS = tuple(
    "new says said report reports first latest major big better just company users user people model models tool tools product products platform service services technology tech artificial "
    "intelligence today year years week day time way world make makes made will get gets using use uses used show shows could would may might like more most set plans plan wants want take takes "
    "help helps comes ahead back next own real good best top".split()
)
#: Common function words of English; callers may pass others.
STOP_WORDS = tuple(
    "a about above after again against all also am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each few for from "
    "further had has have having he her here hers him his how however i if in into is it its itself me more most must my no nor not now of off on once only or other our ours out over own per "
    "same she should since so some still such than that the their them then there these they this those though through to too toward under until up upon us very was we were what when where "
    "whether which while who whom whose why with within without would yet you your yours".split()
)
