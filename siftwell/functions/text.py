"""Text functions: normalisation, retrieval tokens, prompts and keyword clean-up. All are Column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)[\s\x{1c}-\x{1f}]+"
TOKEN = r"[a-z0-9]+|[\x{4e00}-\x{9fff}]+|[\p{L}\p{N}]"
HAN = r"[\x{4e00}-\x{9fff}]"

# Instructions, prompt texts, prefixes and word lists that results depend on.
INSTRUCTION_HISTORY = "給定一個問題，請檢索出語意最相關的歷史問答。"
INSTRUCTION_SIMILAR = "給定一個問題，請檢索出語意最相關、問題表述最相近的問題。"
NO_SUB_QUERY = "1. 無提供子查詢"
LABEL_PREFIXES = ["回答段落：", "回答：", "段落：", "關鍵詞：", "keywords:", "keyword:", "passage:"]
META_STRONG = ["thinking process", "analyze the request", "identify key information"]
META_PROMPT = ["input:", "task:", "source:", "constraint", "<question>", "<passage>", "<keywords>"]
BAD_STARTS_LOWER = ["passage:", "question:", "keyword:", "keywords:", "task:", "input:", "source:"]
BAD_STARTS = ["問題：", "段落：", "關鍵詞：", "回答段落：", "回答："]
STOP_WORDS = ["什麼", "是否", "需要", "可能", "進一步", "出現", "反覆", "長期", "目前", "相關", "有關", "這些", "這種", "這個", "那個", "問題", "原因", "結果", "正常", "以及", "或者", "或是", "如果", "因此", "可以", "應該", "怎麼", "如何", "哪裡", "什麼樣"]
MERGE_AFTER = ["檢查", "治療", "就醫", "手術", "藥物", "藥", "疾病", "風險", "病變", "感染", "功能", "內科", "外科", "門診"]
KEYWORD_SPLIT = r"[\n,;|]+"
KEYWORD_PREFIX = r"(?i)^(keywords?|key phrases?|terms?)\s*:\s*"
LEADING_BULLET = r"^\s*(?:[-*•]|\d+[.)])\s*"
CONNECTOR = r"[，。；？！、]|以及|而且|並且|或者|或是|以及|以及|和|與|或|但"
D2K_LINES = [
    "請根據問題與段落內容，從段落中抽取最多 {keyword_count} 個適合檢索的短關鍵詞或短片語。",
    "請優先使用繁體中文關鍵詞；英文專有名詞或縮寫可保留原文。",
    "關鍵詞必須直接來自段落內容，且要和問題主題高度相關。",
    "請優先抽取問題中未直接出現、但對檢索有幫助的補充資訊詞，例如就醫科別、急診處置、送醫時機、安全措施、自傷或傷人風險、病史紀錄、藥物治療、心理輔導、家庭支持。",
    "除非段落中沒有其他更合適的資訊，否則不要優先輸出只是重複問題症狀的詞。",
    "請盡量保留疾病名稱、檢查、治療、藥物、器官、部位、風險因子與具體處置等資訊詞，避免過於籠統的詞。",
    "不要輸出解釋、推理過程、標題、條列符號、句子或其他額外文字。",
    "只輸出一行，以半形逗號分隔的關鍵詞列表。",
]
Q2D_LINES = [
    "請根據問題生成一段簡短且具體的回答段落。",
    "請使用繁體中文作答。",
    "段落內容必須直接回答問題，並包含和問題主題最相關的處置、風險、就醫方式或其他關鍵資訊。",
    "請優先補充問題中未明說、但對就醫與處理有幫助的資訊，例如就醫科別、急診或送醫時機、安全處置、觀察與記錄重點、可能風險、後續治療或家庭支持。",
    "不要只重複問題中的症狀詞，段落中至少要包含一到兩項具體補充資訊。",
    "不要輸出推理過程、分析、標題、條列符號、前言、結語或其他額外格式。",
    "只輸出一段自然語言回答，不要重複題目。",
    "請與其他可能的回答保持合理差異，可從不同但相關的角度切入。",
]
Q2D_FOCUS = [
    "先說明家屬當下應如何維持安全與穩定現場。",
    "先說明陪同就醫、急診處理與尋求專業協助的流程。",
    "先說明家屬與患者溝通時應避免的行為與合適的互動方式。",
    "先說明可記錄哪些症狀、發作時間與誘發因素供醫師判斷。",
    "先說明何時屬於高風險情況，需要立即送醫或求助。",
    "先說明後續治療配合、家庭支持與持續觀察的重點。",
]


def normalize_text(c: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def question_text(c: Column) -> Column:
    return normalize_text(F.coalesce(c, F.lit("")))


def document_text(question: Column, answer: Column, mode: str = "joined") -> Column:
    """joined: both by a space; question: only it; question_answer: labelled lines."""
    q, a = question_text(question), question_text(answer)
    if mode == "joined":
        return normalize_text(F.concat_ws(" ", q, a))
    if mode == "question":
        return q
    if mode in ("question_answer", "question+answer"):
        return F.concat(F.lit("Question: "), q, F.lit("\nAnswer: "), a)
    raise ValueError(f"unknown text mode: {mode}")


def expand_run(t: Column) -> Column:
    """A run of n > 1 Han characters gives its n - 1 bigrams, then its n characters."""
    n = F.length(t)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(t, i, F.lit(2)))
    ones = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(t, i, F.lit(1)))
    return F.when((n > 1) & t.rlike(f"^{HAN}"), F.concat(pairs, ones)).otherwise(F.array(t))


def tokens(c: Column) -> Column:
    """Lower-case runs of a-z0-9, Han runs expanded, and single other letters and numbers."""
    # white space is in no token, so it needs no normalising
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))
    # expanding is interpreted sign by sign, so texts without Han are spared it
    return F.when(F.coalesce(c, F.lit("")).rlike(HAN), F.flatten(F.transform(found, expand_run))).otherwise(found)


def with_instruction(query: Column, instruction: str | None) -> Column:
    if instruction is None or not instruction.strip():
        return query
    return F.concat(F.lit(f"Instruct: {instruction.strip()}\nQuery:"), query)


def pair_prompt(query: Column, document: Column, instruction: str) -> Column:
    return F.concat(F.lit(f"<Instruct>: {instruction}\n<Query>: "), query, F.lit("\n<Document>: "), normalize_text(document))


def q2d_prompt(query: Column, hint: Column | None = None) -> Column:
    lines = [F.lit(x) for x in Q2D_LINES]
    if hint is not None:
        lines.append(F.concat(F.lit("本次請優先聚焦："), hint))
    return F.trim(F.concat_ws("\n", *lines, F.concat(F.lit("問題："), query), F.lit("回答段落：")))


def d2k_prompt(query: Column, passage: Column, keyword_count: int) -> Column:
    lines = [F.lit(x.replace("{keyword_count}", str(keyword_count))) for x in D2K_LINES]
    return F.trim(F.concat_ws("\n", *lines, F.concat(F.lit("問題："), query), F.concat(F.lit("段落："), passage), F.lit("關鍵詞：")))


def q2d_focus(round_: Column, passage: Column) -> Column:
    """The focus of a round's passage, both counted from 1."""
    return F.element_at(F.array(*map(F.lit, Q2D_FOCUS)), (((round_ - 1) * 10 + (passage - 1)) % len(Q2D_FOCUS) + 1).cast("int"))


@cache
def folded_signs() -> dict[str, str]:
    """The lower-case signs that case folding changes further, and what to; none lies beyond the second plane."""
    signs = (chr(i) for i in range(0x80, 0x20000) if not 0xD800 <= i < 0xE000)
    return {c: c.casefold() for c in signs if c.lower() == c and c.casefold() != c}


def casefold(c: Column) -> Column:
    """Full case folding: lower case, and what remains to be folded sign by sign, in texts that have such signs."""
    low, signs = F.lower(c), folded_signs()
    table = F.str_to_map(F.lit("\x01".join(f"{a}\x02{b}" for a, b in signs.items())), F.lit("\x01"), F.lit("\x02"))
    folded = F.array_join(F.transform(F.split(low, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.when(low.rlike("[" + "".join(signs) + "]"), folded).otherwise(low)


def canonical_keyword(c: Column, fold=casefold) -> Column:
    return fold(F.regexp_replace(normalize_text(c), "^[.,!?;:]+|[.,!?;:]+$", ""))


def sanitize_generated(c: Column) -> Column:
    """Peel label prefixes, in their order, whatever their case."""
    def peel(out: Column, p: Column) -> Column:
        return F.when(F.startswith(casefold(out), p), normalize_text(F.substring(out, F.length(p) + 1, F.length(out)))).otherwise(out)

    return F.aggregate(F.array(*(F.lit(p.casefold()) for p in LABEL_PREFIXES)), normalize_text(c), peel)


def meta_hits(c: Column) -> Column:
    low = casefold(c)
    return F.size(F.filter(F.array(*map(F.lit, META_PROMPT)), lambda m: F.contains(low, m)))


def is_meta_text(c: Column) -> Column:
    t = normalize_text(c)
    low, hits = casefold(t), meta_hits(t)
    stars = F.length(t) - F.length(F.replace(t, F.lit("*"), F.lit("")))
    strong = F.exists(F.array(*map(F.lit, META_STRONG)), lambda m: F.contains(low, m))
    return strong | (hits >= 2) | ((stars >= 4) & (hits >= 1))


def is_invalid_keyword(c: Column) -> Column:
    t = normalize_text(c)
    low = casefold(t)
    begins = lambda text, starts: F.exists(F.array(*map(F.lit, starts)), lambda p: F.startswith(text, p))
    bad = (t == "") | begins(low, BAD_STARTS_LOWER) | begins(t, BAD_STARTS)
    blanks = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return bad | is_meta_text(t) | (~t.rlike(HAN) & ((F.length(t) >= 80) | (blanks >= 6)))


def is_useful_token(c: Column) -> Column:
    han = c.rlike(HAN)
    return ~c.rlike(r"(?U)^[\W_]+$") & F.when(han, ~c.isin(STOP_WORDS) & (F.length(c) >= 2)).otherwise(c.rlike("[A-Za-z0-9]") & (F.length(c) >= 2))


def parse_keywords(c: Column, limit: int | None = None) -> Column:
    """Keywords of a generated list, invalid ones left out, up to limit.

    Long Han phrases stay whole here; expansion.parsed_keywords() splits them by a segmenter before it counts.
    """
    text = F.replace(sanitize_generated(c), F.lit("<KEYWORDS>:"), F.lit(""))
    text = F.regexp_replace(text, KEYWORD_PREFIX, "")
    parts = F.transform(F.split(text, KEYWORD_SPLIT), lambda s: normalize_text(F.regexp_replace(F.regexp_replace(s, LEADING_BULLET, ""), r"""^[ "'\[\](){}]+|[ "'\[\](){}]+$""", "")))
    good = F.filter(parts, lambda s: (s != "") & ~is_invalid_keyword(s))
    return F.when((text == "") | is_meta_text(text), F.array().cast("array<string>")).otherwise(good if limit is None else F.slice(good, 1, limit))
