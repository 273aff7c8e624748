"""The source table: loading it and a starting set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SOURCES

# Words a general feed must mention.
KEYWORDS = [
    "AI", "人工智能", "大模型", "机器学习", "深度学习", "LLM", "GPT", "Claude", "DeepSeek", "Gemini", "transformer", "神经网络",
    "自然语言", "计算机视觉", "AIGC", "生成式", "智能体", "Agent", "RAG", "多模态", "diffusion", "embedding", "向量", "OpenAI",
    "Anthropic", "百度", "文心", "通义", "Kimi", "豆包", "混元", "智谱", "ChatGPT", "Copilot", "Sora", "Midjourney",
    "Stable Diffusion", "芯片", "GPU", "算力", "训练", "推理",
]

# Fixed values: (id, name, type, family, address, query, fetch limit, language, minutes, trust, keywords, credential, enabled).
SEEDS = [
    ("src_0001", "OpenAI News RSS", "rss", "company_announcement", "https://openai.com/news/rss.xml", None, None, "en", 60, 0.95, False, None, True),
    ("src_0002", "Google AI Blog RSS", "rss", "company_announcement", "https://blog.google/innovation-and-ai/technology/ai/rss/", None, None, "en", 120, 0.9, False, None, True),
    ("src_0003", "Google Research RSS", "rss", "research", "https://research.google/blog/rss/", None, None, "en", 180, 0.9, False, None, True),
    ("src_0004", "NVIDIA Blog RSS", "rss", "technology_media", "https://blogs.nvidia.com/feed/", None, None, "en", 120, 0.86, False, None, True),
    ("src_0005", "NVIDIA Developer Blog RSS", "rss", "technology_media", "https://developer.nvidia.com/blog/feed/", None, None, "en", 180, 0.84, False, None, True),
    ("src_0006", "Hugging Face Blog RSS", "rss", "product_launch", "https://huggingface.co/blog/feed.xml", None, None, "en", 180, 0.82, False, None, True),
    ("src_0007", "MIT Technology Review RSS", "rss", "technology_media", "https://www.technologyreview.com/feed/", None, None, "en", 120, 0.78, False, None, True),
    ("src_0008", "arXiv AI Recent", "arxiv", "research", "https://export.arxiv.org/api/query?search_query=cat:cs.AI&sortBy=submittedDate&sortOrder=descending", None, None, "en", 180, 0.9, False, None, True),
    ("src_0009", "NewsAPI AI Query", "newsapi", "technology_media", "https://newsapi.org/v2/everything?q=artificial%20intelligence", None, None, "en", 60, 0.68, False, "NEWSAPI_KEY", False),
    ("src_0010", "Semantic Scholar AI Papers", "semantic_scholar", "research", "https://api.semanticscholar.org/graph/v1/paper/search", "artificial intelligence agents", 10, "en", 240, 0.84, False, "SEMANTIC_SCHOLAR_API_KEY", False),
    ("src_0011", "Hacker News AI Search", "hacker_news", "community", "https://hacker-news.firebaseio.com/v0/newstories.json", "AI", 30, "en", 30, 0.58, False, None, True),
    ("src_0012", "Anthropic Newsroom", "rss", "company_announcement", "https://www.anthropic.com/news", None, None, "en", 120, 0.92, False, None, False),
    ("src_0013", "Product Hunt AI Launches", "product_hunt", "product_launch", "https://api.producthunt.com/v2/api/graphql", "artificial-intelligence", 10, "en", 720, 0.62, False, "PRODUCT_HUNT_TOKEN", False),
    ("src_0014", "Crossref AI Works", "crossref", "research", "https://api.crossref.org/works?query=artificial%20intelligence", None, None, "en", 720, 0.76, False, None, False),
    ("src_0015", "量子位 QbitAI", "rss", "technology_media", "https://www.qbitai.com/feed", None, None, "zh-CN", 60, 0.82, False, None, True),
    ("src_0016", "InfoQ China", "rss", "technology_media", "https://www.infoq.cn/feed", None, None, "zh-CN", 120, 0.78, False, None, True),
    ("src_0017", "36氪 36Kr", "rss", "technology_media", "https://36kr.com/feed", None, None, "zh-CN", 60, 0.76, True, None, True),
    ("src_0018", "雷峰网 Leiphone", "rss", "technology_media", "https://www.leiphone.com/feed", None, None, "zh-CN", 120, 0.74, True, None, True),
    ("src_0019", "钛媒体 TMTPost", "rss", "technology_media", "https://www.tmtpost.com/feed", None, None, "zh-CN", 120, 0.72, True, None, True),
    ("src_0020", "爱范儿 ifanr", "rss", "technology_media", "https://www.ifanr.com/feed", None, None, "zh-CN", 120, 0.7, True, None, True),
    ("src_0021", "FreeBuf", "rss", "technology_media", "https://www.freebuf.com/feed", None, None, "zh-CN", 120, 0.68, False, None, True),
    ("src_0022", "开源中国 OSChina", "rss", "technology_media", "https://www.oschina.net/news/rss", None, None, "zh-CN", 120, 0.66, True, None, True),
    ("src_0023", "少数派 SSPai", "rss", "technology_media", "https://sspai.com/feed", None, None, "zh-CN", 180, 0.64, True, None, True),
    ("src_0024", "阮一峰科技爱好者周刊", "atom", "technology_media", "https://www.ruanyifeng.com/blog/atom.xml", None, None, "zh-CN", 1440, 0.72, False, None, True),
    ("src_0025", "Solidot 奇客", "rss", "technology_media", "https://www.solidot.org/index.rss", None, None, "zh-CN", 120, 0.6, True, None, True),
    ("src_0026", "cnBeta", "rss", "technology_media", "https://www.cnbeta.com.tw/backend.php", None, None, "zh-CN", 60, 0.58, True, None, True),
]


def seed_sources(spark: SparkSession) -> DataFrame:
    """The starting source list, in order."""
    rows = []
    for ident, name, kind, family, address, query, limit, language, minutes, trust, keyed, credential, enabled in SEEDS:
        feed = kind in ("rss", "atom")
        rows.append(
            (
                ident, name, kind, family, address if feed else None, None if feed else address, query, language,
                KEYWORDS if keyed else None, limit, minutes, None, trust, credential, False, True, True, True, enabled, None,
            )
        )
    return spark.createDataFrame(rows, SOURCES)


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """Sources from JSON lines with the fixed schema."""
    return spark.read.schema(SOURCES).json(path)
