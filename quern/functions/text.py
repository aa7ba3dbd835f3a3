"""Column functions over text: tokens, years, normal forms, answers, quotes and signatures.

Patterns name their character classes outright, because \\w, \\s and \\b mean different things in different regex
engines; so the same pattern gives the same result in Java, RE2 and Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WORD = r"\p{L}\p{N}_Ѐ-ӿ؀-ۿ一-鿿"
SPACE = r"\s\p{Z}\x1c-\x1f\x{85}"
NUMBER = rf"[-+]?(?:[0-9]+(?:[{SPACE},][0-9]+)*(?:\.[0-9]+)?|\.[0-9]+)"
YEAR = r"(?<![\p{L}\p{N}_])(19[6-9][0-9]|20[0-2][0-9])(?![\p{L}\p{N}_])"
INSUFFICIENT = "insufficient information"
ABSTENTIONS = ("insufficient information", "недостаточно информации", "информация отсутствует", "невозможно рассчитать")
ANSWER_UNITS = "KZT|PLN|CNY|IDR|PKR|EGP|INR|USD|EUR|тенге|руб|%|percent"
BOXED = r"(?i)\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
FINAL = r"(?i)\[FINAL ANSWER\]:[\s\p{Z}]*([^\n\r]+)"
PLAIN_DECIMAL = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"


def tokens(text: Column) -> Column:
    """Lower-case words; words of six characters or more also as '#' + their first five, CJK words also as bigrams."""
    digits = lambda t: t.rlike(r"^\p{Nd}+$")
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), F.lit(0)), lambda t: (F.char_length(t) >= 2) | digits(t))
    nothing = F.array().cast("array<string>")

    def forms(t: Column) -> Column:
        stem = F.when((F.char_length(t) >= 6) & ~digits(t), F.array(F.concat(F.lit("#"), F.substring(t, 1, 5)))).otherwise(nothing)
        pairs = F.transform(F.sequence(F.lit(1), F.char_length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        pairs = F.when(t.rlike("[一-鿿]") & (F.char_length(t) >= 2), pairs).otherwise(nothing)
        return F.concat(F.array(t), stem, pairs)

    return F.flatten(F.transform(words, forms))


def bag(text: Column) -> Column:
    """The same tokens in another order: by patterns over the whole text, which is much faster than word by word."""
    lower = F.lower(text)
    words = F.regexp_extract_all(lower, F.lit(rf"[{WORD}]{{2,}}|\p{{Nd}}"), F.lit(0))
    long_ = F.regexp_extract_all(lower, F.lit(rf"(?<![{WORD}])(?!\p{{Nd}}+(?![{WORD}]))[{WORD}]{{5}}(?=[{WORD}])"), F.lit(0))
    stems = F.transform(long_, lambda x: F.concat(F.lit("#"), x))
    cjk = F.filter(words, lambda t: t.rlike("[一-鿿]") & (F.char_length(t) >= 2))
    pairs = F.flatten(F.transform(cjk, lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))))
    return F.concat(words, stems, F.when(lower.rlike("[一-鿿]"), pairs).otherwise(F.array().cast("array<string>")))


def years(text: Column) -> Column:
    """Years 1960 to 2029 that stand alone, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(text: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return strip(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def normal(text: Column) -> Column:
    return F.lower(squeeze(text))


def source_id(value: Column) -> Column:
    """The s_... identifier in a value, else the value."""
    found = F.regexp_extract(value, "s_[a-zA-Z0-9_]+", 0)
    return F.when(found != "", found).otherwise(value)


def plain_number(raw: Column) -> Column:
    """A number without group separators and final full stops."""
    return F.regexp_replace(F.regexp_replace(strip(raw), rf"(?<=[0-9])[{SPACE},]+(?=[0-9])", ""), r"\.+$", "")


def is_plain_decimal(value: Column) -> Column:
    """A finite decimal without separators or exponent, of at most 100 digits and |exponent| of at most 100."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    significant = F.regexp_replace(digits, "^0+", "")
    whole = F.char_length(F.regexp_replace(F.regexp_extract(value, r"^[+-]?([0-9]*)", 1), "^0+", ""))
    lead = F.char_length(F.regexp_extract(value, r"^[+-]?0*\.(0*)", 1))
    return F.coalesce(value.rlike(f"^(?:{PLAIN_DECIMAL})$") & (F.char_length(significant) <= 100) & (whole <= 101) & (lead <= 99), F.lit(False))


def _last(values: Column) -> Column:
    return F.when(F.size(values) > 0, strip(F.element_at(values, -1)))


def last_line(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), strip), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.element_at(lines, -1))


def answer(text: Column) -> Column:
    """struct(value, unit) of a response: the last boxed answer, else the last [FINAL ANSWER]:, else the last line.

    An abstention phrase gives the sentinel; a number gives its plain form and a unit, listed or what is left over.
    Code is not run here: see functions.calculator.
    """
    text = strip(text)
    boxed = _last(F.regexp_extract_all(text, F.lit(BOXED), F.lit(1)))
    final = _last(F.regexp_extract_all(text, F.lit(FINAL), F.lit(1)))
    candidate = F.coalesce(F.nullif(boxed, F.lit("")), F.nullif(final, F.lit("")), last_line(text))
    lower = F.lower(candidate)
    abstains = F.lit(False)
    for phrase in ABSTENTIONS:
        abstains = abstains | lower.contains(phrase)
    number = F.regexp_extract(candidate, NUMBER, 0)
    context = F.concat_ws(" ", candidate, last_line(text))
    listed = F.regexp_extract(context, rf"(?i)(?<![\p{{L}}\p{{N}}_])({ANSWER_UNITS})(?![\p{{L}}\p{{N}}_])", 1)
    rest = strip(F.regexp_replace(F.replace(candidate, number, F.lit("")), r"\\boxed|[{}]", ""))
    value = F.when(abstains, INSUFFICIENT).when(number != "", plain_number(number)).otherwise(candidate)
    unit = F.when(abstains | (number == ""), None).when(listed != "", listed).otherwise(F.nullif(rest, F.lit("")))
    return F.struct(value.alias("value"), unit.alias("unit"))


def exact_match(pred: Column, gold: Column) -> Column:
    """Equal after trimming and lower-casing; decimals within 0.01; the sentinel only equals itself; null never."""
    p, g = F.lower(strip(pred)), F.lower(strip(gold))
    dp, dg = p.try_cast("decimal(38,10)"), g.try_cast("decimal(38,10)")
    numbers = F.abs(dp - dg) <= F.lit("0.01").cast("decimal(3,2)")
    same = F.when((p == INSUFFICIENT) | (g == INSUFFICIENT), p == g).when(dp.isNotNull() & dg.isNotNull(), numbers).otherwise(p == g)
    return F.coalesce(same, F.lit(False))


def tolerant_match(pred: Column, gold: Column, tolerance: float = 0.01) -> Column:
    """Exact, or within 1, or within the tolerance relative to max(|gold|, 1)."""
    p, g = strip(pred).try_cast("double"), strip(gold).try_cast("double")
    gap = F.abs(p - g)
    near = (gap <= 1.0) | (gap / F.greatest(F.abs(g), F.lit(1.0)) <= tolerance)
    return exact_match(pred, gold) | F.coalesce(near, F.lit(False))


def duplicate_signature(*texts: Column) -> Column:
    """Equal for texts that differ in case, white space and numbers only."""
    return F.regexp_replace(normal(F.concat_ws(" ", *texts)), r"[0-9]+(?:[.,][0-9]+)*", "#")


def starts_formula(*values: Column) -> Column:
    return F.exists(F.array(*values), lambda x: F.coalesce(F.ltrim(x).startswith("="), F.lit(False)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.ceil(F.octet_length(text) / 2) + 512, F.lit(256)).cast("long")


def quoted(text: Column) -> Column:
    """The text as a regular expression that matches itself."""
    return F.regexp_replace(text, r"([\\\[\](){}.*+?^$|])", r"\\$1")


def bind_quote(quote: Column, text: Column) -> Column:
    """The slice of text that a quote stands for, or null.

    An exact occurrence is taken as it is; otherwise white space may differ and the place must be unique.
    """
    words = F.array_join(F.transform(F.filter(F.split(F.regexp_replace(quote, r"\p{Cc}", " "), rf"[{SPACE}]+"), lambda w: w != ""), quoted), rf"[{SPACE}]+")
    unique = F.regexp_count(text, words) == 1
    return F.when(text.contains(quote), quote).when((words != "") & unique, F.call_function("regexp_extract", text, words, F.lit(0)))


def render(template: Column, case_year: Column) -> Column:
    return F.replace(template, F.lit("{case_year}"), case_year.cast("string"))


def omit(text: Column, fragment: Column) -> Column:
    """The text without a fragment that occurs exactly once and holds no placeholder; null otherwise."""
    times = (F.char_length(text) - F.char_length(F.replace(text, fragment, F.lit("")))) / F.nullif(F.char_length(fragment), F.lit(0))
    return F.when((times == 1) & ~fragment.contains("{"), squeeze(F.replace(text, fragment, F.lit(" "))))


def redact(message: Column) -> Column:
    """A provider's message without urls and long key-like strings, at most 500 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(message, r"https?://[^\s]+", "[url]"), r"[A-Za-z0-9_-]{24,}", "[secret]"), 1, 500)


def error_category(message: Column, status: Column) -> Column:
    m = F.lower(message)
    some = lambda *terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(m, t))
    return (
        F.when(some("too many states", "schema complexity", "schema is too complex", "nesting depth"), "schema_complexity")
        .when(some("unsupported", "not supported", "unknown field", "unrecognized request"), "unsupported_parameter")
        .when(status == 429, "rate_limit")
        .when(status.isin(401, 403), "authentication_or_permission")
        .when(status == 400, "request_validation")
        .otherwise("provider_error")
    )


def file_name(disposition: Column, url: Column) -> Column:
    """The name in a Content-Disposition header, else the url path's last segment; null if it is unsafe."""
    named = F.regexp_extract(disposition, r"(?i)filename\*?=(?:UTF-8'')?\"?([^\";]+)", 1)
    last = F.url_decode(F.regexp_extract(url, r"^[^?#]*/([^/?#]*)", 1))
    name = F.coalesce(F.nullif(named, F.lit("")), F.nullif(last, F.lit("")))
    return F.when(name.rlike(r"[/\\\x00-\x1f]|^\.{1,2}$"), None).otherwise(name)


def article_context(text: Column, number: Column) -> Column:
    """Up to 12000 characters from the heading that bears an article number, of 50 characters at least."""
    n = quoted(number)
    patterns = [F.concat(F.lit(p), n, F.lit(r"(?![0-9])[\s\S]{0,12000}")) for p in (r"(?m)^\s*Статья\s+", r"(?m)^\s*Article\s+", r"(?m)^\s*Section\s+")]
    patterns.append(F.concat(F.lit(r"(?m)^\s*"), n, F.lit(r"-бап[\s\S]{0,12000}")))
    found = [F.call_function("regexp_extract", text, p, F.lit(0)) for p in patterns]
    return F.coalesce(*(F.when(F.char_length(f) >= 50, f) for f in found))
