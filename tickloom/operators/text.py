"""Text operators on feeds, filings and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Query parameters that only track (a trailing _ marks a prefix).
TRACKING = (
    "utm_", "guce_", "ncid", "fbclid", "gclid", "ref", "source", "campaign", "si", "mc_cid", "mc_eid", "sref", "taid", "mod", "cmpid",
)

# News categories in order of precedence, with their key words.
CATEGORIES = {
    "index": [
        "s&p 500", "s&p500", "sp500", "nasdaq", "dow jones", "djia", "russell 2000", "russell2000", "vix", "日経平均", "日経225", "nikkei",
        "topix", "ftse", "dax", "stoxx", "cac 40", "stock index", "株価指数", "指数",
    ],
    "mag7": [
        "apple", "aapl", "iphone", "アップル", "microsoft", "msft", "azure", "マイクロソフト", "google", "googl", "goog", "alphabet", "グーグル",
        "amazon", "amzn", "aws", "アマゾン", "nvidia", "nvda", "エヌビディア", "meta platforms", "meta", "facebook", "メタ", "tesla", "tsla", "テスラ",
    ],
    "macro": [
        "fed", "federal reserve", "fomc", "boj", "ecb", "日銀", "中央銀行", "interest rate", "金利", "利上げ", "利下げ", "rate cut", "rate hike",
        "inflation", "cpi", "インフレ", "物価", "gdp", "economic growth", "recession", "景気", "employment", "unemployment", "payroll", "non-farm",
        "nonfarm", "jobless", "雇用", "失業率", "treasury", "yield", "国債", "債券",
    ],
    "sector": [
        "technology sector", "tech sector", "energy sector", "healthcare sector", "healthcare stocks", "financial sector", "financials",
        "consumer discretionary", "consumer staples", "industrials", "materials", "utilities", "real estate", "pharmaceutical",
        "sector rotation", "sector performance", "セクター", "業種",
    ],
    "theme": [
        "artificial intelligence", "ai investment", "ai stocks", "generative ai", "人工知能", "生成ai", "semiconductor", "chip", "半導体",
        "electric vehicle", "ev", "電気自動車", "renewable energy", "clean energy", "solar", "wind power", "再生可能エネルギー", "クリーンエネルギー",
        "blockchain", "cryptocurrency", "quantum computing", "space economy", "cybersecurity",
    ],
}

# Phrases of a paywall.
PAYWALL = [
    "subscribe to continue", "sign in to read", "premium content", "members only", "paywall", "unlock this article",
    "start your free trial", "already a subscriber", "create an account to read", "有料会員限定", "続きを読むには", "ログインして", "会員登録が必要", "月額",
    "プレミアム記事", "有料プラン",
]

# Exchange codes and ticker suffixes.
EXCHANGES = {
    "US": "", "UW": "", "UN": "", "UA": "", "UR": "", "UF": "", "LN": ".L", "QM": ".L", "VX": ".L", "FP": ".PA", "GY": ".DE", "GR": ".DE",
    "NA": ".AS", "SW": ".SW", "IM": ".MI", "SM": ".MC", "SS": ".ST", "DC": ".CO", "NO": ".OL", "FH": ".HE", "BB": ".BR", "PL": ".LS",
    "CN": ".TO", "CT": ".TO", "BZ": ".SA", "MM": ".MX", "JT": ".T", "HK": ".HK", "AT": ".AX", "AU": ".AX", "SP": ".SI", "KS": ".KS",
    "IN": ".NS", "IJ": ".JK", "TT": ".TW", "PM": ".PS", "TB": ".BK", "MK": ".KL", "SJ": ".JO", "QD": ".QA", "TI": ".IS", "RM": ".ME",
}

# Key words of the kinds of moat, first match wins.
MOATS = {
    "brand_power": [
        "ブランド", "brand", "認知", "awareness", "ロイヤルティ", "loyalty",
    ],
    "switching_cost": [
        "スイッチング", "switching", "移行コスト", "ロックイン", "lock-in", "粘着",
    ],
    "network_effect": [
        "ネットワーク効果", "network effect", "エコシステム", "ecosystem", "プラットフォーム", "platform",
    ],
    "cost_advantage": [
        "コスト優位", "cost advantage", "規模の経済", "economies of scale", "ベンダー交渉", "密度",
    ],
    "intangible_assets": [
        "特許", "patent", "ライセンス", "license", "技術力", "ノウハウ", "know-how", "買収",
    ],
    "efficient_scale": [
        "効率的規模", "efficient scale", "参入障壁", "barrier",
    ],
}


def normalise_url(url: Column | str) -> Column:
    """Trailing slashes off before parsing (so /a/#x keeps its slash), host lower-case without www., no fragment, no
    /index.html, no tracking or blank parameters. Parameters are decoded and encoded again (space as +, escapes in upper
    case), those of one name behind its first."""
    url = F.col(url) if isinstance(url, str) else url
    u = F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", "")
    u = F.regexp_replace(u, "#.*$", "")
    head = F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)", 1)
    site = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)?([^?]*)", 1), "/index\\.html$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)

    def tracks(name: Column) -> Column:
        out = F.lit(False)
        for t in TRACKING:
            out = out | (F.startswith(name, F.lit(t)) if t.endswith("_") else name == t)
        return out

    def decoded(x: Column) -> Column:  # a percent sign that begins no escape stands for itself
        return F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))

    def encoded(x: Column) -> Column:
        return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    given = F.transform(
        F.filter(F.split(query, "&"), lambda x: x.rlike("^[^=]*=.")),
        lambda x: F.struct(decoded(F.regexp_extract(x, "^([^=]*)", 1)).alias("name"), decoded(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("value")),
    )

    def written(pairs: Column) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda x: x["name"]))
        ordered = F.flatten(F.transform(names, lambda n: F.filter(pairs, lambda x: x["name"] == n)))
        return F.array_join(F.transform(ordered, lambda x: F.concat(encoded(x["name"]), F.lit("="), encoded(x["value"]))), "&")

    kept = _once(F.filter(given, lambda x: ~tracks(x["name"])), written)
    return F.concat(F.lower(head), site, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def domain(url: Column | str) -> Column:
    from .cleaning import host

    return F.regexp_replace(host(url), r"^www\.", "")


def title_words(title: Column | str) -> Column:
    title = F.col(title) if isinstance(title, str) else title
    return F.array_distinct(F.filter(F.split(F.lower(title), r"\s+"), lambda w: w != ""))


def title_similarity(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the lower-cased words; 0 if either has none."""
    x, y = title_words(a), title_words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)))


def _hits(text: Column, words: list[str]) -> Column:
    """How many of the words a text contains."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def _once(value: Column, body) -> Column:
    """body(value), with value computed once: an expression that occurs many times would be evaluated as often."""
    return F.transform(F.array(value), body)[0]


def categorise(text: Column, categories: dict[str, list[str]] | None = None) -> Column:
    """(category, confidence) of the first category with a key word in the lower-cased text; a quarter a key word, at
    most 1; 'other' and 0 without any."""

    def pick(low: Column) -> Column:
        out = F.struct(F.lit("other").alias("category"), F.lit(0.0).alias("confidence"))
        for name, words in reversed((categories or CATEGORIES).items()):
            n = _hits(low, words)
            out = F.when(n > 0, F.struct(F.lit(name).alias("category"), F.least(n * 0.25, F.lit(1.0)).cast("double").alias("confidence"))).otherwise(out)
        return out

    return _once(F.lower(F.coalesce(text, F.lit(""))), pick)


def paywalled(text: Column | str, short: int = 200, medium: int = 1500) -> Column:
    """One phrase in a short text, two in a medium one."""
    text = F.col(text) if isinstance(text, str) else text
    size = F.length(text)

    def test(low: Column) -> Column:
        return ((size < short) & (_hits(low, PAYWALL) >= 1)) | ((size < medium) & (_hits(low, PAYWALL) >= 2))

    return F.when(size < medium, _once(F.lower(text), test)).when(size >= medium, F.lit(False))


def clean_lines(text: Column | str) -> Column:
    """Trimmed lines without blank ones."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), "\n")


def collapse(text: Column | str) -> Column:
    """Runs of white space within a line to one blank, three and more line feeds to two, trimmed."""
    text = F.col(text) if isinstance(text, str) else text
    t = F.regexp_replace(F.regexp_replace(text, "[^\\S\n]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def sections(df: DataFrame, text: str, patterns: dict[str, str], key: str) -> DataFrame:
    """(key, section, position, content): where each pattern first matches, up to the next section found."""
    at = F.array(*[F.struct(F.regexp_instr(F.col(text), F.lit(p)).alias("position"), F.lit(n).alias("section")) for n, p in patterns.items()])
    found = F.array_sort(F.filter(at, lambda s: s["position"] > 0))
    d = df.select(key, text, found.alias("f"), F.posexplode(found).alias("i", "s"))
    following = F.coalesce(F.get("f", F.col("i") + 1)["position"], F.length(text) + 1)
    return d.select(key, "s.section", "s.position", F.substr(F.col(text), F.col("s.position"), following - F.col("s.position")).alias("content"))


def transcript_sections(text: Column | str) -> Column:
    """Array of (kind, speaker, content) from marks like <q speaker>...</q>; empty contents are dropped."""
    text = F.col(text) if isinstance(text, str) else text
    pattern = r"(?s)<(\w+) ([^>]*)>(.*?)</\w+>"
    kinds, who, said = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3))
    both = F.arrays_zip(kinds.alias("kind"), who.alias("speaker"), F.transform(said, lambda s: F.trim(F.regexp_replace(s, r"[\s-]*---\s*$", ""))).alias("content"))
    return F.filter(both, lambda x: x["content"] != "")


def fiscal_period(headline: Column | str, year: Column | str, month: Column | str) -> Column:
    """Q1 2024 or H1 2024 out of a headline, else the calendar quarter, else the empty text."""
    h, y, m = (F.col(x) if isinstance(x, str) else x for x in (headline, year, month))
    named = [F.regexp_extract(F.coalesce(h, F.lit("")), p, 1) for p in (r"(Q[1-4]\s+\d{4})", r"(H[12]\s+\d{4})")]
    calendar = F.when((y > 0) & (m > 0), F.concat(F.lit("Q"), (F.floor((m - 1) / 3) + 1).cast("string"), F.lit(" "), y.cast("string"))).otherwise("")
    return F.when(named[0] != "", named[0]).when(named[1] != "", named[1]).otherwise(calendar)


def convert_ticker(ticker: Column | str, overrides: dict[str, str] | None = None) -> Column:
    """'7203 JT Equity' to '7203.T'; overrides first; unknown exchanges and other forms stay as they are (trimmed)."""
    t = F.trim(F.col(ticker) if isinstance(ticker, str) else ticker)
    parts = F.split(t, r"\s+")
    suffix = F.create_map(*[F.lit(x) for pair in EXCHANGES.items() for x in pair])
    found = F.element_at(suffix, F.upper(F.get(parts, F.lit(1))))
    out = F.when((F.size(parts) >= 2) & found.isNotNull(), F.concat(F.get(parts, F.lit(0)), found)).otherwise(t)
    for k, v in (overrides or {}).items():
        out = F.when(t == k, F.lit(v)).otherwise(out)
    return out


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def claim_confidence(structural: Column, common: Column, quantitative: Column, compared: Column) -> Column:
    """Score of the twelve-rule evaluation, from 50, limited to 10..90 (rules 5, 9, 10 and 12 are neutral)."""

    def rule(test: Column, yes: int, no: int) -> Column:
        return F.when(test, yes).otherwise(no)

    total = F.lit(50) + rule(structural, 0, -30) + rule(structural, 0, -10) + rule(~common, 0, -30) + rule(quantitative, 20, -10) + rule(structural, 10, -10)
    total = total + rule(compared, 15, -10) + rule(structural, 0, -20) + rule(structural & compared & quantitative, 30, 0)
    return F.greatest(F.lit(10), F.least(F.lit(90), total))


def confidence_band(score: Column) -> Column:
    """90, 70, 50, 30 or 10: the level that a score falls into."""
    return F.when(score >= 80, 90).when(score >= 60, 70).when(score >= 40, 50).when(score >= 20, 30).otherwise(10)


def moat_kind(claim: Column | str, evidence: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (claim, evidence))

    def pick(low: Column) -> Column:
        out = F.lit("none")
        for name, words in reversed(MOATS.items()):
            out = F.when(_hits(low, words) > 0, name).otherwise(out)
        return out

    return _once(F.lower(F.concat(a, F.lit(" "), b)), pick)


def moat_score(claims: DataFrame) -> DataFrame:
    """claims(ticker, moat, confidence) -> (ticker, overall, strength, dominant): whole-number averages; the dominant kind
    has the highest average, ties to the first name."""
    per = claims.groupBy("ticker", "moat").agg(F.sum("confidence").alias("s"), F.count("*").alias("k"))
    per = per.withColumn("a", F.floor(F.col("s") / F.col("k")))
    named = F.when((F.col("moat") != "none") & (F.col("a") > 0), F.struct((-F.col("a")).alias("a"), F.col("moat").alias("m")))
    g = per.groupBy("ticker").agg(F.floor(F.sum("s") / F.sum("k")).alias("o"), F.min(named).alias("d"))
    o = F.col("o")
    return g.select("ticker", o.cast("int").alias("overall"), F.when(o >= 70, "wide").when(o >= 40, "narrow").otherwise("none").alias("strength"), F.col("d.m").alias("dominant"))


def five_forces(concentration: Column, barriers: Column, substitutes: Column, suppliers: Column, buyers: Column) -> Column:
    """Overall intensity from low / medium / high levels; concentration and barriers work the other way round."""

    def level(c: Column, turned: bool = False) -> Column:
        low, high = (3, 1) if turned else (1, 3)
        return F.when(c == "low", low).when(c == "high", high).otherwise(2)

    mean = (level(concentration, True) + level(barriers, True) + level(substitutes) + level(suppliers) + level(buyers)) / 5
    return F.when(mean >= 2.5, "high").when(mean >= 1.5, "medium").otherwise("low")


def group_by_category(df: DataFrame, category: str, mapping: dict[str, str], fallback: str) -> DataFrame:
    """(category, day, n, first): articles by mapped category and day; ids are not collected, so groups of any size do."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    named = F.coalesce(F.element_at(table, F.col(category)), F.lit(fallback))
    return df.groupBy(named.alias("category"), "day").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def newest(df: DataFrame, date: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """Newest first, missing dates last; one sorted limit, no ranking of the whole table."""
    return df.orderBy(F.desc_nulls_last(date), tie).offset(offset).limit(limit)


def top_per(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)
