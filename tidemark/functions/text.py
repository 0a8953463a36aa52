"""Text cleaning and rule-based news analysis as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp, half_up

# White space of scripts on pages (with the byte order mark), and of texts.
PAGE_SPACE = "[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
SPACE = "[\\s\\x0b\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}

# Words of good news, of bad news and of news that matters.
POSITIVE = ["증가", "성장", "확대", "상향", "수주", "흑자", "개선", "회복", "호조", "승인", "돌파", "협력", "투자", "growth", "raise", "raised", "beat", "beats", "surge", "record", "improve", "approval", "contract"]
NEGATIVE = ["감소", "하락", "축소", "하향", "적자", "부진", "지연", "규제", "소송", "리콜", "중단", "해킹", "우려", "decline", "cut", "miss", "delay", "lawsuit", "recall", "probe", "warning", "risk", "sliding"]
MATERIAL = ["실적", "매출", "영업이익", "순이익", "가이던스", "수주", "계약", "인수", "합병", "유상증자", "배당", "자사주", "규제", "소송", "earnings", "revenue", "profit", "guidance", "forecast", "acquisition", "merger", "dividend", "buyback"]
# Kinds of events in order, with Korean words and English patterns.
EVENTS = [
    ("실적·가이던스", ["실적", "매출"], "earnings|revenue|guidance|forecast"),
    ("수주·사업계약", ["수주", "계약"], "contract|order"),
    ("규제·법률", ["규제", "소송"], "regulation|lawsuit|probe"),
    ("투자·파트너십", ["투자", "협력"], "investment|partnership"),
]
OTHER_EVENT = "산업·시장동향"
# What a reading says of a direction, of its best and worst case, and what to watch.
DIRECTIONS = ["이익 기대 또는 사업 가시성에 우호적", "실적 또는 밸류에이션의 하방 위험을 높일 수 있는", "방향성이 확정되지 않은"]
SUMMARY = [" 관련 ", " 뉴스입니다. ", " 신호로 분류했습니다."]
BULL = ["보도 내용이 실제 매출·이익 추정치 상향으로 연결되면 주가 재평가의 근거가 됩니다.", "추가 공시에서 정량적 성과가 확인되면 중립 판단이 개선될 수 있습니다."]
BEAR = ["부정 요인이 장기화되거나 비용으로 현실화되면 현재 기대치를 낮춰야 합니다.", "기사에 계약 금액·이익 기여 시점이 없으면 기대감만 선반영됐을 가능성이 있습니다."]
WATCH = ["회사 공시 또는 공식 발표로 사실 확인", "다음 실적 추정치 변화", "동일 사건의 후속 보도와 가격·거래량 반응"]
# Particles in the order in which they are tried, and words that are no keywords.
PARTICLES = ["으로써", "에서는", "으로는", "이라고", "라고는", "에게서", "으로", "에서", "에는", "과는", "와는", "이나", "까지", "부터", "보다", "처럼", "만큼", "라고", "이라", "에도", "에게", "한테", "이다", "하다", "했다", "된다", "됐다", "이라는", "라는", "은", "는", "이", "가", "을", "를", "의", "에", "도", "만", "과", "와", "로", "야", "요"]
STOPWORDS = [
    "기자", "연합뉴스", "뉴스", "사진", "제공", "지난해", "올해", "내년", "지난", "이날", "관련", "대한", "위해", "통해", "따르면", "밝혔다", "말했다", "전했다", "대해", "가운데",
    "지난달", "이번", "당시", "현재", "최근", "오전", "오후", "서울", "기준", "경우", "가장", "모두", "다시", "함께", "이후", "이상", "이하", "그러나", "하지만", "때문", "라며",
    "면서", "무단", "전재", "배포", "금지", "저작권", "구독", "댓글", "그리고", "또한", "예정", "계획", "발표", "설명",
    "the", "and", "for", "with", "from", "that", "this", "has", "have", "was", "were", "will", "its", "inc", "corp", "ltd", "said", "says", "filed", "filer", "file", "type",
    "act", "size", "item", "year", "end", "state", "reuters", "bloomberg", "read", "more", "news",
]
# What marks a paragraph that is no news.
BOILERPLATE = r"(?i)저작권자|무단\s*전재|재배포\s*금지|제보는|구독하기|기사제보|All rights reserved|Copyright ⓒ"


def character(number: Column) -> Column:
    """The character of a code point; empty if there is none."""
    return F.when((number > 0) & (number <= 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.lit(""))


def decode_entities(c: Column, unknown: str = "keep") -> Column:
    """Character references decoded in one pass; unknown names are kept or, with "space", become a space. Code-point arithmetic stays in the plan."""

    def one(piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, r"^&(#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);$", 1))
        digits = F.regexp_extract(name, r"^#(\d{1,9})$", 1)
        hexes = F.regexp_extract(name, r"^#x0*([0-9a-f]{1,7})$", 1)
        out = F.when(name == "", piece)
        for word, sign in NAMED.items():
            out = out.when(name == word, F.lit(sign))
        out = out.when(digits != "", character(digits.try_cast("long"))).when(hexes != "", character(F.conv(hexes, 16, 10).try_cast("long")))
        return out.when(name.startswith("#"), F.lit("")).otherwise(F.lit(" ") if unknown == "space" else piece)

    pieces = F.regexp_extract_all(c, F.lit(r"(?s)&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);|[^&]+|&"), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def clean_text(c: Column, length: int = 6000) -> Column:
    """Decoded text without scripts, styles and tags, white space folded and trimmed, cut to a length."""
    out = decode_entities(F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    out = F.regexp_replace(out, r"(?is)<script\b[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style\b[^>]*>.*?</style>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), f"{PAGE_SPACE}+", " ")
    return F.substring(F.trim(out), 1, length)


def plain(c: Column) -> Column:
    """A fragment of a page as text: tags and unknown references become spaces."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(c, r"<[^>]+>", " "), "space"), f"{SPACE}+", " "))


def extract_body(html: Column, length: int = 9000, least: int = 20) -> Column:
    """An article's text: its paragraphs of some length that aren't boilerplate, if two or more; else its longest block, else all of it."""
    clean = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?is)<(script|style|noscript|iframe|svg|form|nav|header|footer|aside)\b[^>]*>.*?</\1>", " ")
    parts = F.transform(F.regexp_extract_all(clean, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), plain)
    parts = F.filter(parts, lambda p: (F.length(p) >= least) & ~p.rlike(BOILERPLATE))
    blocks = F.transform(F.regexp_extract_all(clean, F.lit(r"(?is)<(article|section|div)\b[^>]*>(.*?)</\1>"), F.lit(2)), plain)
    longest = F.aggregate(blocks, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    other = F.when(F.size(blocks) > 0, longest).otherwise(plain(clean))
    return F.substring(F.when(F.size(parts) >= 2, F.array_join(parts, "\n")).otherwise(other), 1, length)


def lexicon_count(low: Column, words: list[str]) -> Column:
    """How many of the words a lower-cased text holds, as substrings."""
    return sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))


def occurrences(c: Column, alias: str) -> Column:
    """How often a text holds an alias: Latin ones without case and not inside Latin words or numbers, others as they are."""
    if alias.isascii():
        return F.regexp_count(c, F.lit(rf"(?i)(?<![A-Za-z0-9])\Q{alias}\E(?![A-Za-z0-9])"))
    return ((F.length(c) - F.length(F.replace(c, F.lit(alias), F.lit("")))) / len(alias)).cast("int")


def sentences(compact: Column) -> Column:
    """Sentences of a text."""
    return F.split(compact, r"(?<=[.!?。])\s+", -1)


def analyze_news(text: Column, symbol: Column, company: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE, material: list[str] = MATERIAL) -> dict[str, Column]:
    """The rule-based reading of a text as named columns over those of counted(), which the caller puts in place first, so each is computed once; numbers run from 0 to 100."""
    compact, low, pos, neg, important = (F.col(f"_{c}") for c in ("compact", "low", "pos", "neg", "important"))
    raw = pos - neg
    explicit = F.contains(low, F.lower(symbol)) | F.contains(compact, company)
    sentiment = F.when(raw > 0, "긍정").when(raw < 0, "부정").otherwise("중립")
    materiality = F.when(important >= 3, "높음").when(important >= 1, "보통").otherwise("낮음")
    event = F.col("_event")
    horizon = F.when(event == EVENTS[0][0], "중기(1~2분기)").when(event == EVENTS[1][0], "장기(1년+)").when(materiality == "낮음", "당일").otherwise("단기(1~4주)")
    factor = F.when(materiality == "높음", 2.4).when(materiality == "보통", 1.5).otherwise(0.7)
    long = F.filter(sentences(compact), lambda s: F.length(s) > 18)
    evidence = F.transform(F.slice(F.when(F.size(long) > 0, long).otherwise(F.array(compact)), 1, 3), lambda s: F.substring(s, 1, 150))
    direction = F.when(raw > 0, DIRECTIONS[0]).when(raw < 0, DIRECTIONS[1]).otherwise(DIRECTIONS[2])
    return {
        "sentiment": sentiment,
        "sentiment_score": clamp(50 + raw * 11, 0, 100),
        "relevance": clamp(F.when(explicit, 76).otherwise(48) + F.least(important * 5, F.lit(19)), 0, 100),
        "materiality": materiality,
        "event_type": event,
        "impact_horizon": horizon,
        "confidence": clamp(52 + F.when(explicit, 15).otherwise(0) + F.least(F.length(compact) / 45, F.lit(18.0)) + important * 2, 0, 100),
        "score_adjustment": half_up(clamp(raw * factor, -8, 8)).cast("int"),
        "analysis_summary": F.concat(company, F.lit(SUMMARY[0]), event, F.lit(SUMMARY[1]), direction, F.lit(SUMMARY[2])),
        "evidence": evidence,
        "bull_case": F.when(pos > 0, BULL[0]).otherwise(BULL[1]),
        "bear_case": F.when(neg > 0, BEAR[0]).otherwise(BEAR[1]),
        "watch_items": F.array(*map(F.lit, WATCH)),
    }


def counted(text: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE, material: list[str] = MATERIAL) -> list[dict[str, Column]]:
    """Layers of columns that analyze_news() reads: the folded text, the same without case, then the counts of words in it and the kind of event."""
    held = lambda words: lexicon_count(F.col("_low"), words)
    event = F.lit(OTHER_EVENT)
    for name, korean, pattern in reversed(EVENTS):
        event = F.when(reduce(lambda a, b: a | b, [F.contains("_low", F.lit(w)) for w in [*korean, *pattern.split("|")]]), name).otherwise(event)
    return [
        {"_compact": F.trim(F.regexp_replace(text, f"{SPACE}+", " "))},
        {"_low": F.lower("_compact")},
        {"_pos": held(positive), "_neg": held(negative), "_important": held(material), "_event": event},
    ]


def strip_particle(token: Column) -> Column:
    """A Korean token without the first particle of the list that it ends in, if more than one character stays.

    In the list no particle stands before one that ends in it, so the first that fits is the longest: the leftmost match before the end.
    """
    return F.when(F.right(token, F.lit(1)).between("가", "힣"), F.regexp_replace(token, f"(?<=..)(?:{'|'.join(PARTICLES)})$", "")).otherwise(token)


def keyword(token: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Whether a token, rid of its particle, can be a keyword."""
    return F.length(token).between(2, 20) & ~F.lower(token).isin(stopwords) & ~token.rlike("^[0-9]+$") & ~token.rlike("^[A-Za-z]{1,3}$")


def content_hash(title: Column, excerpt: Column) -> Column:
    """What tells whether an item's text changed."""
    return F.sha2(F.concat_ws("\n", title, excerpt), 256)


def title_key(c: Column) -> Column:
    """A title without case, punctuation and white space."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
