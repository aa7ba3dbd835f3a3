"""Surrogates for personal data and secrets, by DataFrame functions alone.

Detected: e-mail addresses, telephone numbers, IPv4 addresses, card-like numbers (13 to 19 digits), social
security numbers, IBANs, secrets (values named token, secret, password or key, and known key shapes) and persons
with a title (Latin and Cyrillic; a name without a title is not told from other capitalised words).

An entity is a kind and a canonical form, equal for all its spellings.  It gets one surrogate in canonical form (its
core), drawn from a keyed digest, and each occurrence is written from the core in its own format:

* numbers: digits by digits; separators and the country code stay (its length follows from its first digits, so it does
  not depend on the spelling); cards get a valid check digit, IBANs keep the country and get valid check digits;
* e-mail addresses and secrets: letters by letters of the same script and case, digits by digits; the last label of a
  domain and the prefix of a known key shape stay, hexadecimal stays hexadecimal;
* persons: given and family names are entities of their own, so Mr. John Smith and Mr. Smith share a surrogate family
  name.  Given names follow the title's gender and the script, family names the script (Cyrillic ones also the
  gender); upper case stays.  Each further draw of a name is one syllable longer, so names can't run out.

The same entity gets the same surrogate in all documents (coreference).  Distinct entities of a kind get distinct
cores, none of which is itself an entity of the corpus: cores are grouped and joined with the originals, all but the
first of a colliding group are drawn again with another digest, until no collision is left.

The texts are searched once; documents with their matches are stored.  Only documents with entities are shuffled.  Which
surrogate goes where is joined by the text's digest, so copies are resolved once.

Defined results.  A null text stays null; texts without entities stay as they are.  Very long texts are searched whole;
every pattern takes time linear in them.  Rows with equal doc_id are separate documents.  Other columns are kept
whatever their names; if docs has a column pii_entities, the new one's name gets underscores until it is free.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, free_name, stored

# Titles and names.
MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|господин|г-н"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Srta|госпожа|г-жа"
OTHER_TITLES = "Dr|Prof|доктор"
MALE = "Adam Ben Carl David Emil Felix George Henry Ivan Jonas Karl Louis Martin Noah Oscar Paul Robert Simon Thomas Victor".split()
FEMALE = "Alice Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sophie Tina Vera".split()
ANY = "Alex Robin Sasha Kim Jo Andrea Chris Dominique Sam Charlie".split()
MALE_CYRILLIC = "Адам Борис Виктор Денис Егор Иван Кирилл Лев Максим Олег".split()
FEMALE_CYRILLIC = "Алла Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга".split()
SYLLABLES = "ba be da do fa ga ha ka la le ma mo na ne pa ra re sa ta va".split()
#: Calling codes of one and of two digits; all others have three.
SHORT_CODES = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
SYLLABLES_CYRILLIC = "ба бе да до ва га ка ла ле ма мо на не па ра ре са та ви зо".split()

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLED = rf"{_EDGE}(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.? {_NAME}(?: {_NAME})?"
_SECRET_NAMES = "token|secret|password|passwd|api_key|apikey|api-key|access_key|key"
PATTERNS = (
    rf"(?<=(?i:{_SECRET_NAMES})\s{{0,2}}[=:]\s{{0,2}}[\"']{{0,1}})(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{12,}}",
    rf"{_EDGE}(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,}}){_END}",
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){1,100}+",
    rf"{_EDGE}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
    rf"(?<![\p{{L}}\p{{N}}.])(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?![\p{{L}}\p{{N}}]|\.\d)",
    rf"(?<![\p{{L}}\p{{N}}+])\+\d{{1,3}}[ .-]?\(?\d{{2,4}}\)?(?:[ .-]?\d{{2,4}}){{2,4}}{_END}",
    rf"(?<![\p{{L}}\p{{N}}])\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}{_END}",
    rf"{_EDGE}\d{{3}}[.-]\d{{3}}[.-]\d{{4}}{_END}",
    rf"{_EDGE}\d{{3}}-\d{{2}}-\d{{4}}{_END}",
    rf"{_EDGE}(?:\d[ -]?){{12,18}}\d{_END}",
    _TITLED,
)
#: One pattern for all, so that extracting and splitting agree on every boundary.
ENTITY = "|".join(PATTERNS)
#: A text without this holds no entity; it is much cheaper to look for.
HINT = rf"\d\D{{0,2}}\d\D{{0,2}}\d|@|(?i:token|secret|passw|key)|AKIA|gh[pousr]_|sk-|{_EDGE}(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.? \p{{Lu}}"


def kind(match: Column) -> Column:
    return (
        F.when(match.contains("@"), "email")
        .when(match.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), "ipv4")
        .when(match.rlike(r"^[+(]") | match.rlike(r"^\d{3}([.-])\d{3}[.-]\d{4}$"), "phone")
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(match.rlike(r"^\d[\d -]+\d$"), "card")
        .when(match.rlike(r"^[A-Z]{2}\d{2}( ?[A-Z0-9]{4}){3,7}( ?[A-Z0-9]{1,3})?$"), "iban")
        .when(match.rlike(_TITLED), F.concat(F.lit("person:"), _gender(match), _script(match)))
        .otherwise("secret")
    )


def _title(match: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(match, r"^\S+", 0), r"\.$", "")


def _gender(match: Column) -> Column:
    title = _title(match)
    return F.when(title.rlike(f"^({MALE_TITLES})$"), "m").when(title.rlike(f"^({FEMALE_TITLES})$"), "f").otherwise("n")


def _script(match: Column) -> Column:
    return F.when(match.rlike(r"\p{IsCyrillic}"), "c").otherwise("l")


def _name(match: Column) -> Column:
    return F.regexp_replace(match, r"^\S+ ", "")


def parts(kind_: Column, match: Column) -> Column:
    """The entities of a match: an array of struct(kind, canon).  Of a person the family name and then the given name."""
    number = F.regexp_replace(match, r"[^\p{L}\p{N}]", "")
    canon = (
        F.when(kind_ == "email", F.lower(match))
        .when(kind_ == "phone", F.concat(F.when(match.startswith("+"), "+").otherwise(""), number))
        .when(kind_.isin("ssn", "card", "iban"), number)
        .otherwise(match)
    )
    name, gender, script = F.lower(_name(match)), F.substring(kind_, 8, 1), F.substring(kind_, 9, 1)
    entity = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    family = entity(F.concat(F.lit("family:"), F.when(script == "c", gender).otherwise(""), script), F.regexp_extract(name, r"\S+$", 0))
    given = entity(F.concat(F.lit("given:"), gender, script), F.regexp_extract(name, r"^\S+", 0))
    return F.when(~kind_.startswith("person"), F.array(entity(kind_, canon))).when(name.contains(" "), F.array(family, given)).otherwise(F.array(family))


def stream(key: str, kind_: Column, canonical_: Column, attempt: Column) -> Column:
    """128 hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind_, canonical_, attempt.cast("string")), 512)


def _below(n: int, symbols: Column, i: Column) -> Column:
    """A number under n for each place i of a stream."""
    return F.pmod(F.xxhash64(symbols, i), F.lit(n)).cast("int")


def _pick(words: list[str], symbols: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), _below(len(words), symbols, F.lit(-1)) + 1)


_LOWER, _LOWER_CYRILLIC, _LOWER_GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
_HAN = "".join(map(chr, range(0x4E00, 0x4E00 + 128)))


def _refill(text: Column, symbols: Column, hexadecimal: Column | None = None) -> Column:
    """Digits by digits and letters by letters of their script and case, each drawn for its place."""

    def one(c: Column, i: Column) -> Column:
        letter = lambda alphabet: F.substring(F.lit(alphabet), _below(len(alphabet), symbols, i) + 1, F.lit(1))
        drawn = (
            F.when(c.rlike(r"\p{IsCyrillic}"), letter(_LOWER_CYRILLIC)).when(c.rlike(r"\p{IsGreek}"), letter(_LOWER_GREEK)).when(c.rlike(r"\p{IsHan}"), letter(_HAN)).otherwise(letter(_LOWER))
        )
        if hexadecimal is not None:
            drawn = F.when(hexadecimal, letter("abcdef")).otherwise(drawn)
        return (
            F.when(~c.rlike(r"[\p{L}\p{N}]"), c).when(c.rlike(r"\p{N}"), _below(10, symbols, i).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(drawn)).otherwise(drawn)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _check_digit(digits: Column) -> Column:
    """What makes a number end validly (Luhn): every second digit from the right is doubled."""
    n = F.char_length(digits)

    def add(total: Column, x: Column) -> Column:
        return total + F.when(x > 9, x - 9).otherwise(x)

    doubled = F.transform(F.split(digits, ""), lambda c, i: c.cast("int") * (1 + (n - i) % 2))
    return F.pmod(-F.aggregate(doubled, F.lit(0), add), F.lit(10)).cast("string")


def _iban(country: Column, account: Column) -> Column:
    """An IBAN with valid check digits: the number that letters and digits spell is 1 modulo 97."""

    def add(total: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), total * 10 + c.cast("int")).otherwise(total * 100 + F.ascii(c) - 55) % 97

    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), add)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _new_name(kind_: Column, symbols: Column, attempt: Column) -> Column:
    """A family or given name in lower case; each attempt after the first takes one syllable more."""
    cyrillic, gender = kind_.endswith("c"), F.regexp_extract(kind_, ":(.).$", 1)
    female, male = gender == "f", gender == "m"
    syllables = lambda words, n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(F.array(*map(F.lit, words)), _below(len(words), symbols, i) + 1)), "")
    family = F.when(cyrillic, F.concat(syllables(SYLLABLES_CYRILLIC, attempt + 4), F.when(female, "ва").otherwise("в"))).otherwise(F.concat(syllables(SYLLABLES, attempt + 4), F.lit("n")))
    listed = (
        F.when(cyrillic & female, _pick(FEMALE_CYRILLIC, symbols)).when(cyrillic, _pick(MALE_CYRILLIC, symbols)).when(male, _pick(MALE, symbols)).when(female, _pick(FEMALE, symbols)).otherwise(_pick(ANY, symbols))
    )
    longer = F.when(cyrillic, F.concat(syllables(SYLLABLES_CYRILLIC, attempt + 1), F.when(female, "на").otherwise("н"))).otherwise(
        F.concat(syllables(SYLLABLES, attempt + 1), F.when(female, "la").when(male, "ro").otherwise("ry"))
    )
    return F.when(kind_.startswith("family"), family).when(attempt > 0, longer).otherwise(F.lower(listed))


def core(kind_: Column, canon: Column, symbols: Column, attempt: Column) -> Column:
    """An entity's surrogate in canonical form."""
    octets = F.concat_ws(".", *((_below(254, symbols, F.lit(i)) + 1).cast("string") for i in range(4)))
    code = F.regexp_extract(canon, rf"^\+(?:{SHORT_CODES}|\d{{3}})", 0)
    top = F.regexp_extract(canon, r"\.[^.]*$", 0)
    prefix = F.regexp_extract(canon, "^(?:AKIA|gh[pousr]_|sk-)", 0)
    after = lambda x: F.substring(canon, F.char_length(x) + 1, F.char_length(canon))
    card = F.substring(_refill(canon, symbols), F.lit(1), F.char_length(canon) - 1)
    return (
        F.when(kind_ == "ipv4", octets)
        .when(kind_ == "email", F.concat(_refill(F.substring(canon, F.lit(1), F.char_length(canon) - F.char_length(top)), symbols), top))
        .when(kind_ == "phone", F.concat(code, _refill(after(code), symbols)))
        .when(kind_ == "card", F.concat(card, _check_digit(card)))
        .when(kind_ == "iban", _iban(F.substring(canon, 1, 2), _refill(F.substring(canon, 5, 40), symbols)))
        .when(kind_ == "secret", F.concat(prefix, _refill(after(prefix), symbols, canon.rlike("^[0-9a-f]{12,}$"))))
        .when(kind_ == "ssn", _refill(canon, symbols))
        .otherwise(_new_name(kind_, symbols, attempt))
    )


def rendered(kind_: Column, match: Column, cores: Column) -> Column:
    """What takes the place of a match, in its own format, from the cores of its parts."""
    first, second = F.get(cores, F.lit(0)), F.get(cores, F.lit(1))
    filling = F.split(F.regexp_replace(first, r"[^\p{L}\p{N}]", ""), "")
    # digits and letters of a number go where its own stand; numbers are short
    taken = lambda i: F.char_length(F.regexp_replace(F.substring(match, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
    number = F.array_join(F.transform(F.split(match, ""), lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), F.get(filling, taken(i))).otherwise(c)), "")
    cased = F.array_join(F.zip_with(F.split(match, ""), F.split(first, ""), lambda c, x: F.when(c.rlike(r"\p{Lu}"), F.upper(x)).otherwise(x)), "")
    styled = lambda was, x: F.when(F.upper(was) == was, F.upper(x)).otherwise(F.initcap(x))
    name = F.concat_ws(" ", styled(F.regexp_extract(_name(match), r"^\S+", 0), second), styled(F.regexp_extract(match, r"\S+$", 0), first))
    return (
        F.when(kind_.startswith("person"), F.concat(F.regexp_extract(match, r"^\S+ ", 0), name))
        .when(kind_.isin("phone", "ssn", "card", "iban"), number)
        .when((kind_ == "email") & (F.char_length(match) == F.char_length(first)), cased)
        .otherwise(first)
    )


def entities_of(text: Column) -> Column:
    """The matches in a text, in order."""
    nothing = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(nothing)


def assign(entities: DataFrame, key: str, max_rounds: int = 100) -> DataFrame:
    """(kind, canon, core) for distinct entities (kind, canon), free of collisions."""
    now = stored(entities.withColumn("attempt", F.lit(0)), "pii-entities")
    for _ in range(max_rounds):
        drawn = now.withColumn("symbols", stream(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        drawn = stored(drawn.select("kind", "canon", "attempt", core(F.col("kind"), F.col("canon"), F.col("symbols"), F.col("attempt")).alias("core")), "pii-drawn")
        discard(now)
        first = drawn.groupBy("kind", "core").agg(F.min("canon").alias("first"), F.count(F.lit(1)).alias("n"))
        shared = first.filter("n > 1").select("kind", "core", "first")
        real = drawn.select("kind", F.col("canon").alias("core"), F.lit(True).alias("real"))
        judged = drawn.join(shared, ["kind", "core"], "left").join(real, ["kind", "core"], "left")
        again = F.coalesce(F.col("first") < F.col("canon"), F.lit(False)) | F.col("real").isNotNull()
        judged = stored(judged.select("kind", "canon", "core", "attempt", again.alias("again")), "pii-judged")
        discard(drawn)
        if not judged.filter("again").limit(1).count():
            return judged.select("kind", "canon", "core")
        now = stored(judged.select("kind", "canon", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")), "pii-again")
        discard(judged)
    raise RuntimeError(f"surrogates still collide after {max_rounds} draws")


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text and a last column pii_entities: array<struct<kind, surrogate>> in text order."""
    names = docs.columns
    docs = docs.toDF(*("text" if n == "text" else f"c{i}" for i, n in enumerate(names)))
    searched = stored(docs.withColumn("pii_m", entities_of(F.col("text"))), "pii-searched")
    some, none = searched.filter("size(pii_m) > 0"), searched.filter("size(pii_m) < 1")
    digest = F.sha2(F.col("text"), 256)
    lists = some.select(digest.alias("pii_text"), "pii_m").groupBy("pii_text").agg(F.first("pii_m").alias("m"))
    each = lists.select("pii_text", F.posexplode("m").alias("pos", "match")).withColumn("of", kind(F.col("match")))
    each = each.select("pii_text", "pos", "match", "of", F.posexplode(parts(F.col("of"), F.col("match"))).alias("part", "x"))
    each = stored(each.select("pii_text", "pos", "match", "of", "part", "x.kind", "x.canon"), "pii-matches")
    known = assign(each.select("kind", "canon").distinct(), key)
    cores = F.transform(F.array_sort(F.collect_list(F.struct("part", "core"))), lambda x: x.core)
    made = each.join(known, ["kind", "canon"]).groupBy("pii_text", "pos").agg(F.first("match").alias("match"), F.first("of").alias("of"), cores.alias("cores"))
    made = made.select("pii_text", "pos", F.col("of").alias("kind"), rendered(F.col("of"), F.col("match"), F.col("cores")).alias("surrogate"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "kind", "surrogate")))
    lists = made.groupBy("pii_text").agg(F.transform(ordered, lambda x: F.struct(x.kind.alias("kind"), x.surrogate.alias("surrogate"))).alias("pii_entities"))
    lists = stored(lists, "pii-lists")
    discard(each, known)
    gaps = F.split(F.col("text"), ENTITY, -1)
    fills = F.concat(F.transform("pii_entities", lambda x: x.surrogate), F.array(F.lit("")))
    text = F.array_join(F.zip_with(gaps, fills, lambda a, b: F.concat(a, b)), "")
    changed = some.withColumn("pii_text", digest).join(lists, "pii_text")
    changed = changed.withColumn("text", text).select(*docs.columns, "pii_entities")
    empty = F.array().cast(lists.schema["pii_entities"].dataType)
    return changed.unionByName(none.withColumn("pii_entities", empty).drop("pii_m")).toDF(*names, free_name("pii_entities", names))
