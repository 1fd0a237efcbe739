"""Prompt features computed inside whole-stage codegen.

Texts are long and keywords rare, so a text is lowered once, searched for keywords as
bytes, and only texts that hold one meet a regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tag names, keywords, marks and symbols the features are defined by.
TAGS = ("code", "finance", "general", "law", "math", "medicine", "science")
CODE_LINE_WORDS = ("def", "class", "function", "import", "from", "select", "public static")
CODE_MARKS = ("```", "console.log", "system.out", "#include")
MATH_COMMANDS = ("frac", "sum", "int", "sqrt", "begin")
MATH_SYMBOLS = "∑∫√≈≠≤≥"
MATH_WORDS = ("equation", "proof", "theorem")
MATH_PHRASES = ("방정식", "증명", "정리", "미분", "적분")
TAG_WORDS = {
    "code": ("python", "javascript", "typescript", "java", "rust", "sql", "api", "debug", "algorithm"),
    "math": ("math", "algebra", "geometry", "calculus", "probability"),
    "science": ("physics", "chemistry", "biology", "scientific"),
    "medicine": ("medical", "medicine", "diagnosis", "clinical", "patient"),
    "law": ("law", "legal", "statute", "contract", "court"),
    "finance": ("finance", "investment", "stock", "accounting", "revenue"),
}
TAG_PHRASES = {
    "code": ("파이썬", "자바스크립트", "코드", "디버그", "알고리즘"),
    "math": ("수학", "대수", "기하", "미적분", "확률"),
    "science": ("물리", "화학", "생물", "과학"),
    "medicine": ("의학", "진단", "임상", "환자"),
    "law": ("법률", "법원", "판례", "계약서"),
    "finance": ("금융", "투자", "주식", "회계", "매출"),
}
# Separators that count as space here but not in the regular expressions'
# own Unicode space class, and letters that equal an ASCII letter when case is ignored.
CONTROL_SPACES = "\x1c\x1d\x1e\x1f"
FOLDED_LETTERS, FOLDED_TO = "ſıİ", "sii"


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    hit = text.contains(needles[0])
    for n in needles[1:]:
        hit = hit | text.contains(n)
    return hit


def folded(prompt: Column) -> Column:
    """The text lowered so that plain comparison ignores case."""

    odd = _any(prompt, tuple(FOLDED_LETTERS))
    return F.lower(F.when(odd, F.translate(prompt, FOLDED_LETTERS, FOLDED_TO)).otherwise(prompt))


def _spaced(prompt: Column) -> Column:
    """The text with control separators as spaces."""

    odd = _any(prompt, tuple(CONTROL_SPACES))
    return F.when(odd, F.translate(prompt, CONTROL_SPACES, "    ")).otherwise(prompt)


def _has_word(low: Column, words: tuple[str, ...]) -> Column:
    """One of the words, standing alone.  The expression starts with the literal word,
    which is searched fast, and looks back for the edge before it."""

    alone = "|".join(rf"{w}(?<=\b{w})" for w in words)
    return _any(low, words) & low.rlike(rf"(?U)(?:{alone})\b")


def char_count(prompt: Column) -> Column:
    return F.length(prompt).cast("bigint")


def word_count(prompt: Column) -> Column:
    return F.regexp_count(_spaced(prompt), F.lit(r"(?U)\S+")).cast("bigint")


def line_count(prompt: Column) -> Column:
    return (F.length(prompt) - F.length(F.replace(prompt, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def has_tag_markup(low: Column) -> Column:
    """An opening like ``<a`` or ``</a`` with any ``>`` after it; linear in the text."""

    start = F.regexp_instr(low, F.lit("</?[a-z]"))
    closing = F.call_function("locate", F.lit(">"), low, (start + 2).cast("int"))
    return low.contains("<") & (start > 0) & (closing > 0)


def has_code(low: Column) -> Column:
    """A code mark, a line that opens with a code word, or markup."""

    opening = r"(?U)(?:^|[\r\n])[^\S\r\n]*(?:" + "|".join(CODE_LINE_WORDS) + r")\b"
    line = _any(low, CODE_LINE_WORDS) & _spaced(low).rlike(opening)
    return _any(low, CODE_MARKS) | line | has_tag_markup(low)


def has_math(low: Column, hangul: Column) -> Column:
    """A formula between dollars, a TeX command, a symbol, or a keyword."""

    formula = low.contains("$") & low.rlike(r"\$[^$]+\$")
    command = low.contains("\\") & low.rlike(r"(?U)\\(?:" + "|".join(MATH_COMMANDS) + r")\b")
    phrase = hangul & _any(low, MATH_PHRASES)
    return formula | command | _any(low, tuple(MATH_SYMBOLS)) | _has_word(low, MATH_WORDS) | phrase


def domain_tags(low: Column, hangul: Column, code: Column, math: Column) -> Column:
    """Keyword tags in catalogue order; ``general`` when nothing matched."""

    def present(tag: str) -> Column:
        hit = _has_word(low, TAG_WORDS[tag]) | (hangul & _any(low, TAG_PHRASES[tag]))
        return {"code": code | hit, "math": math | hit}.get(tag, hit)

    found = F.array_compact(
        F.array(*[F.when(present(t), F.lit(t)) for t in TAGS if t != "general"])
    )
    return F.when(F.size(found) == 0, F.array(F.lit("general"))).otherwise(found)


def with_flags(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Adds counts and flags, and the lowered text as ``_low`` for further steps."""

    p, low, hangul = F.col(prompt), F.col("_low"), F.col("_hangul")
    lowered = df.withColumn("_low", folded(p)).withColumn("_hangul", low.rlike("[가-힣]"))
    return lowered.withColumns(
        {
            "n_char": char_count(p),
            "n_word": word_count(p),
            "n_line": line_count(p),
            "has_code": has_code(low),
            "has_math": has_math(low, hangul),
        }
    )


def with_tags(flagged: DataFrame) -> DataFrame:
    """Adds tags to the rows of :func:`with_flags` and drops the lowered text."""

    tags = domain_tags(F.col("_low"), F.col("_hangul"), F.col("has_code"), F.col("has_math"))
    return flagged.withColumn("tags", tags).drop("_low", "_hangul")


def with_surface(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Adds counts, flags and tags; the text is lowered once."""

    return with_tags(with_flags(df, prompt))


def prompt_hash(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def with_hash(rows: DataFrame) -> DataFrame:
    """Adds ``prompt_sha256``; rows without their text have it from ``policies.read_texts``."""

    return rows.withColumn("prompt_sha256", prompt_hash(F.col("prompt"))) if "prompt" in rows.columns else rows
