"""Operator 6, surrogates for personal data, in DataFrame functions only.

Mentions are found by one regular expression. Each distinct entity of the corpus gets
one surrogate, drawn by a keyed hash: the same wherever the entity occurs, different
from every other's and from every original, and alike in type, gender, script and format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.llm._shared import durable, written

_MALE = "Mr|Sir|Herr|Monsieur|Señor|Sr|Signor|Господин|Κύριος"
_FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Signora|Госпожа|Κυρία"
_EITHER = "Dr|Prof"
GIVEN_MALE = "James|John|Robert|Michael|William|David|Richard|Thomas|Charles|Daniel|Matthew|Mark|Paul|Steven|Andrew|Peter|Hans|Klaus|Jürgen|Wolfgang|Stefan|Pierre|Jean|Jacques|Michel|François|Carlos|José|Juan|Luis|Miguel|Javier|Иван|Сергей|Дмитрий|Алексей|Γιώργος|Νίκος"
GIVEN_FEMALE = "Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Lisa|Margaret|Emily|Emma|Anna|Ursula|Monika|Petra|Sabine|Claudia|Marie|Sophie|Isabelle|Nathalie|Camille|María|Carmen|Lucía|Elena|Isabel|Ольга|Наталья|Елена|Мария|Ελένη"
#: A word of a name; the ``'s`` behind one isn't part of it.
_NAME = r"\p{Lu}(?:\p{L}+|['’]\p{Lu}\p{L}+)(?:-\p{L}+|['’]\p{Lu}\p{L}*)*"
#: What may stand between the digits of a phone number.
_GAP = r"[ \u00a0.\u2010\u2011-]"
_PHONES = (
    rf"(?:\+\d{{1,3}}{_GAP}?|(?<!\d)1{_GAP}?)?\(\d{{3}}\){_GAP}?\d{{3}}{_GAP}?\d{{4}}(?!\d)",
    rf"\(0\d{{1,4}}\)(?:[/]|{_GAP})?\d(?:{_GAP}?\d){{4,8}}(?!\d)",
    rf"(?:\+1{_GAP}?|(?<!\d)(?<!\d[.-])(?:1{_GAP})?)\d{{3}}{_GAP}\d{{3}}{_GAP}\d{{4}}(?!\d)",
    rf"\+[1-9](?:(?:/|{_GAP})?(?:\(\d{{1,4}}\){_GAP}?)?\d){{7,14}}(?!\d)",
    r"\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)",
    # Trunk or international zeros before grouped digits, but no date and no decimals.
    rf"(?<!\d)(?<!\d[.,/-])(?!\d\d[./-]\d\d[./-]\d{{4}})(?=0{{1,2}}[1-9]\d{{0,3}}(?:/|{_GAP})\d)0(?:0[1-9](?:(?:/|{_GAP})?\d){{7,12}}|[1-9](?:(?:/|{_GAP})?\d){{7,10}})(?!\d)",
)
_SECRETS = "password|passwd|passphrase|passcode|pwd|token|secret|api[_ -]?key|access[_-]?key|secret[_-]?key|private[_-]?key|auth[_-]?key"
#: In order: where several could begin at one place, the first is taken.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    # The first look-behind is part of the second, and spares most places the longer one.
    "secret": rf"""(?<=[=:>]\s{{0,2}}["']?)(?<=(?i:{_SECRETS})["']?\]?\s{{0,2}}(?:[=:]{{1,2}}|=>)\s{{0,2}}["']?)[^\s"',;&<>]{{6,}}""",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "ipv6": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,35}::)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z]{4})?(?: ?\d{4}){2,6}(?: ?\d{1,4})?\b",
    "card": r"(?<!\d)\d{4}(?:[ -]?\d{4}){3}(?!\d)",
    "phone": "|".join(_PHONES),
    "person": rf"\b(?=\p{{Lu}})(?:(?:{_MALE}|{_FEMALE}|{_EITHER})\.?(?: {_NAME}){{1,3}}|(?:{GIVEN_MALE}|{GIVEN_FEMALE})(?: {_NAME}){{1,2}})",
}
MENTION = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without a match of this has no mention.
HINT = rf"[0-9@=:]|\bAKIA|\b(?=\p{{Lu}})(?:{_MALE}|{_FEMALE}|{_EITHER}|{GIVEN_MALE}|{GIVEN_FEMALE})\b"
DIGITS = ("phone", "card", "ssn")
#: Set around mentions in a text; what a text has of the two itself is written otherwise meanwhile.
MARK, APART = "\ue000", "\ue001"
#: Rounds of drawing again for entities whose surrogate is taken; a space that is used up ends in an error, not in a repeated surrogate.
ROUNDS = 64

_SYLLABLES = {
    "latin": "ba den ko lar mi nel ro pa ri sa tev vin zo gar hal jo kem lu mor na pel qui ras sol tam ur vel wen yar zen bri dro".split(),
    "cyrillic": "ба ден ко лар ми нел ро па ри са тев вин зо гар хал мор на пел рас сол там вел зен бри".split(),
    "greek": "βα δεν κο λαρ μι νελ ρο πα ρι σα τεβ βιν ζο γαρ χαλ μορ να πελ ρας σολ ταμ βελ ζεν".split(),
}
_ENDS = {
    "latin": {"given_m": "an us ek or".split(), "given_f": "a ia ina elle".split(), "given_x": "y en is".split(), "surname": "son er ov ini ski etti".split()},
    "cyrillic": {"given_m": "ан ор ей".split(), "given_f": "а ия ина".split(), "given_x": "и е".split(), "surname": "ов ин енко".split()},
    "greek": {"given_m": "ος ης ας".split(), "given_f": "α η ια".split(), "given_x": "ι ω".split(), "surname": "ου ιδης ακης".split()},
}


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(items: list[str]) -> str:
    return "array(" + ", ".join(map(_text, items)) + ")"


def kind_of(mention: Column) -> Column:
    """The type of a mention, by its own form; what has none is a secret."""
    out = None
    for kind in ("email", "key", "ssn", "ip", "ipv6", "iban", "card", "phone", "person"):
        fits = mention.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out.otherwise("secret")


def parts_of(mention: Column) -> Column:
    """The entities of a mention, end to end with a space between: (type, raw).

    A person's name counts by its words, so that they stay the same in other mentions; a title is not an entity. The first word
    that tells a gender, title or given name, tells it for all. The last word is the surname, unless it is a known given name that
    stands alone behind a title.
    """

    def person(words: Column) -> Column:
        bare = lambda w: F.regexp_replace(w, r"\.$", "")
        telling = F.filter(F.transform(words, bare), lambda w: w.rlike(f"^(?:{_MALE}|{GIVEN_MALE}|{_FEMALE}|{GIVEN_FEMALE})$"))
        first = F.get(telling, F.lit(0))
        gender = F.when(first.rlike(f"^(?:{_MALE}|{GIVEN_MALE})$"), "given_m").when(first.isNotNull(), "given_f").otherwise("given_x")
        title = bare(words[0]).rlike(f"^(?:{_MALE}|{_FEMALE}|{_EITHER})$")
        known = words[1].rlike(f"^(?:{GIVEN_MALE}|{GIVEN_FEMALE})$")
        alone = title & (F.size(words) == 2) & F.coalesce(known, F.lit(False))
        return F.transform(words, lambda w, i: F.struct(F.when((i == 0) & title, "title").when((i == F.size(words) - 1) & ~alone, "surname").otherwise(gender).alias("type"), w.alias("raw")))

    kind = kind_of(mention)
    return F.when(kind == "person", person(F.split(mention, " "))).otherwise(F.array(F.struct(kind.alias("type"), mention.alias("raw"))))


def canon(part: Column) -> Column:
    """What makes two entities of a type the same. A phone number counts without ``+``, ``00`` or a trunk ``(0)``, and without the 1 that a number of ten digits may have in front."""
    digits = F.regexp_replace(part["raw"], "[^0-9]", "")
    phone = F.regexp_replace(F.regexp_replace(F.replace(part["raw"], F.lit("(0)"), F.lit("")), "[^0-9]", ""), r"^(?:00(?=[1-9])|1(?=\d{10}$))", "")
    return (
        F.when(part["type"] == "phone", phone).when(part["type"].isin(*DIGITS), digits).when(part["type"] == "iban", F.replace(part["raw"], F.lit(" "), F.lit("")))
        .when(part["type"].isin("key", "secret", "ip"), part["raw"]).otherwise(F.lower(part["raw"]))
    )


def space_of(kind: Column) -> Column:
    """Where a document looks an entity up: names, whatever their type, in one place."""
    return F.when(kind.startswith("given_") | (kind == "surname"), "name").otherwise(kind)


def _drawn(attempt: int) -> str:
    """SQL for the surrogate of the columns type and canon; ``__h`` holds 128 keyed hex digits, ``__d`` as many for the domain of an address."""
    r = lambda i, m, h="__h": f"cast(pmod(conv(substr({h}, 1 + pmod(3 * ({i}), 126), 3), 16, 10), {m}) AS int)"
    like = lambda v: f"""array_join(transform(sequence(1, greatest(length({v}), 1)), i -> transform(array(substr({v}, i, 1)), c -> CASE
        WHEN c RLIKE '[0-9]' THEN cast({r('i', 10)} AS string)
        WHEN c RLIKE '[a-f]' AND {v} RLIKE '^[0-9a-f]+$' THEN substr('abcdef', 1 + {r('i', 6)}, 1)
        WHEN c RLIKE '[a-z]' THEN char(97 + {r('i', 26)}) WHEN c RLIKE '[A-Z]' THEN char(65 + {r('i', 26)}) ELSE c END)[0]), '')"""  # noqa: E731
    letters = "array_join(transform(sequence(1, 10), i -> char(97 + " + r("i", 26, "__d") + ")), '')"
    ip = f"concat_ws('.', {'10' if not attempt else '240 + ' + r(0, 15)}, {r(1, 256)}, {r(2, 256)}, 1 + {r(3, 254)})"
    # Leading zeros and two digits of what may be a country code stay; of ten digits area and exchange begin with 2 to 9.
    phone = f"""array_join(transform(sequence(1, length(canon)), i -> CASE WHEN i = 1 AND startswith(canon, '0') THEN '0' WHEN i <= 2 AND length(canon) > 10 AND NOT startswith(canon, '0') THEN substr(canon, i, 1)
        WHEN length(canon) = 10 AND NOT startswith(canon, '0') AND i IN (1, 4) THEN cast(2 + {r('i', 8)} AS string) ELSE cast({r('i', 10)} AS string) END), '')"""
    ipv6 = f"array_join(transform(sequence(1, length(canon)), i -> transform(array(substr(canon, i, 1)), c -> CASE WHEN c RLIKE '[0-9]' THEN cast({r('i', 10)} AS string) WHEN c RLIKE '[a-f]' THEN substr('abcdef', 1 + {r('i', 6)}, 1) ELSE c END)[0]), '')"
    # Country and letters as drawn, then the two digits that make the whole 1 modulo 97.
    number = lambda v: f"array_join(transform(split({v}, ''), c -> CASE WHEN c RLIKE '[A-Z]' THEN cast(ascii(c) - 55 AS string) ELSE c END), '')"
    iban = f"""transform(array({like('substr(canon, 5)')}), b -> concat(substr(canon, 1, 2), lpad(cast(98 - coalesce(cast(pmod(try_cast({number("concat(b, substr(canon, 1, 2), '00')")} AS decimal(38, 0)), 97) AS int), {r(30, 90)}) AS string), 2, '0'), b))[0]"""
    body = f"concat(substr(canon, 1, 1), array_join(transform(sequence(2, 15), i -> cast({r('i', 10)} AS string)), ''))"
    card = f"transform(array({body}), b -> concat(b, coalesce(if(luhn_check(canon), filter(transform(sequence(0, 9), c -> cast(c AS string)), c -> luhn_check(concat(b, c)))[0], cast({r(20, 10)} AS string)), '0')))[0]"
    ssn = f"concat('9', array_join(transform(sequence(2, 9), i -> cast({r('i', 10)} AS string)), ''))"
    cases = []
    for script, test in (("cyrillic", r"canon RLIKE '\\p{IsCyrillic}'"), ("greek", r"canon RLIKE '\\p{IsGreek}'"), ("latin", "true")):
        syllables = _SYLLABLES[script]
        stem = f"array_join(transform(sequence(1, {3 + attempt}), i -> {_array(syllables)}[{r('i', len(syllables))}]), '')"
        ends = " ".join(f"WHEN type = '{t}' THEN {_array(e)}[{r(40, len(e))}]" for t, e in _ENDS[script].items())
        cases.append(f"WHEN {test} THEN concat({stem}, CASE {ends} END)")
    return f"""CASE type WHEN 'email' THEN concat({like("substring_index(canon, '@', 1)")}, '@', {letters}, '.example')
        WHEN 'ip' THEN {ip} WHEN 'phone' THEN {phone} WHEN 'card' THEN {card} WHEN 'ssn' THEN {ssn} WHEN 'ipv6' THEN {ipv6} WHEN 'iban' THEN {iban}
        WHEN 'key' THEN concat('AKIA', {like('substr(canon, 5)')}) WHEN 'secret' THEN {like('canon')}
        ELSE CASE {' '.join(cases)} END END"""


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(type, canon, surrogate) for the distinct rows of ``entities`` (type, canon), no surrogate given twice in a type or equal to an original of it. A null or empty canon has none; no entities, no rows."""
    todo = originals = durable(entities.filter("canon IS NOT NULL AND canon <> ''").distinct())
    settled = None
    for attempt in range(ROUNDS):
        h = F.sha2(F.concat_ws("\x01", F.lit(key), "type", "canon", F.lit(str(attempt))), 512)
        d = F.sha2(F.concat_ws("\x01", F.lit(key), F.lit("domain"), F.substring_index("canon", "@", -1)), 512)
        drawn = durable(todo.select("type", "canon", h.alias("__h"), d.alias("__d")).select("type", "canon", F.expr(_drawn(attempt)).alias("surrogate")))
        free = drawn.groupBy("type", "surrogate").agg(F.min("canon").alias("canon"))
        free = free.join(originals.select("type", F.col("canon").alias("surrogate")), ["type", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled, ["type", "surrogate"], "left_anti")
        free = free.select("type", "canon", "surrogate")
        settled = durable(free if settled is None else settled.union(free))
        todo = durable(drawn.select("type", "canon").join(settled, ["type", "canon"], "left_anti"))
        if todo.isEmpty():
            return settled
    raise ValueError("more entities of a type than surrogates")


def _rendered(part: Column, surrogate: Column) -> Column:
    """A surrogate in the format of an occurrence: its separators, its capitals, and digits in front that aren't part of the number."""
    # A trunk (0) keeps its digit, whatever the others become.
    raw = F.when(part["type"] == "phone", F.replace(part["raw"], F.lit("(0)"), F.lit("(\x02)"))).otherwise(part["raw"])
    extra = F.length(F.regexp_replace(raw, "[^0-9]", "")) - F.length(surrogate)
    start = F.struct(F.lit("").alias("out"), (1 - extra).alias("k"))

    def step(a: Column, i: Column) -> Column:
        c = F.substr(raw, i, F.lit(1))
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(a["out"], F.when(digit & (a["k"] > 0), F.substr(surrogate, a["k"], F.lit(1))).otherwise(c)).alias("out"), (a["k"] + digit.cast("int")).alias("k"))

    spaced = F.replace(F.aggregate(F.sequence(F.lit(1), F.length(raw)), start, step, lambda a: a["out"]), F.lit("\x02"), F.lit("0"))
    parted = F.trim(F.regexp_replace(surrogate, "(.{4})", "$1 "))
    loud = (part["raw"] == F.upper(part["raw"])) & (F.length(part["raw"]) > 1)
    name = F.when(loud, F.upper(surrogate)).otherwise(F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substr(surrogate, F.lit(2))))
    return (
        F.when(part["type"] == "title", part["raw"]).when(part["type"].isin(*DIGITS), spaced).when(space_of(part["type"]) == "name", name)
        .when(part["type"].isin("email", "ipv6") & loud, F.upper(surrogate)).when((part["type"] == "iban") & F.contains(part["raw"], F.lit(" ")), parted).otherwise(surrogate)
    )


def _names_in(pieces: Column) -> Column:
    """The spellings under which a document's own names may stand alone: as they were found, in capitals, and with one in front."""
    mentions = F.filter(pieces, lambda x, i: i % 2 == 1)
    words = F.flatten(F.transform(mentions, lambda m: F.transform(F.filter(parts_of(m), lambda p: space_of(p["type"]) == "name"), lambda p: p["raw"])))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.upper(w), F.initcap(F.lower(w))))))


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", found_col: str | None = "n_found") -> DataFrame:
    """``docs`` with every mention in its texts replaced, and the number of places replaced as ``found_col`` (None: without it).

    ``key`` makes surrogates unguessable and, kept, repeatable. Types: email, access key, secret after ``password=`` and the like in any
    case, social security number, IP address, bank account number (IBAN), phone number in the forms of ``_PHONES``, payment card
    number, and persons by title or given name (Latin, Cyrillic or Greek script; masculine, feminine or unknown by any word of
    the name). The same number in another spelling is the same entity, and so is a given name whatever the title: in a document a
    name has one gender, feminine before masculine before unknown. Where a name found in a document stands alone in it, it is
    replaced too.

    Texts without a mention, null and empty ones among them, stay as they are. Each row is a document of its own; equal rows come out
    equal, a null id is an id. Other columns stay; one named ``found_col`` is replaced. An empty table gives no rows. The texts are
    searched once and kept, cut at their mentions, in a table in the shared folder.
    """
    names = [c for c in docs.columns if c != found_col]
    text = F.col(f"`{text_col}`").cast("string")
    plain = F.replace(F.replace(text, F.lit(APART), F.lit(APART + "0")), F.lit(MARK), F.lit(APART + "1"))
    marked = F.when(text.rlike(HINT), F.regexp_replace(plain, MENTION, f"{MARK}$0{MARK}"))
    cut = F.when(F.contains(marked, F.lit(MARK)), F.split(marked, MARK, -1))
    # One struct holds the caller's columns, whatever their names.
    scanned = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("own"), cut.alias("pieces")))
    more = lambda n: [] if found_col is None else [n.cast("long").alias(found_col)]
    quiet = scanned.filter("pieces IS NULL").select("row.*", *more(F.lit(0)))
    loud = scanned.filter("pieces IS NOT NULL").drop("row")
    each = loud.select("own", F.explode(F.array_distinct(F.filter("pieces", lambda x, i: i % 2 == 1))).alias("m")).select("own", F.explode(parts_of(F.col("m"))).alias("p"))
    found = each.filter("p.type <> 'title'").select("own", F.col("p.type").alias("type"), canon(F.col("p")).alias("canon"))
    # Of the types that a document has for a name the least counts: feminine, masculine, unknown, surname.
    mentions = durable(found.groupBy("own", space_of(F.col("type")).alias("space"), "canon").agg(F.min("type").alias("type")))
    given = surrogates(mentions.select("type", "canon"), key)
    entry = F.struct(F.concat("space", F.lit("\x01"), "canon"), F.col("surrogate"))
    own = mentions.join(given, ["type", "canon"]).groupBy("own").agg(F.map_from_entries(F.collect_list(entry)).alias("known"))
    joined = scanned.filter("pieces IS NOT NULL").join(own, "own", "left").withColumn("names", _names_in(F.col("pieces")))

    def shown(part: Column) -> Column:
        surrogate = F.col("known")[F.concat(space_of(part["type"]), F.lit("\x01"), canon(part))]
        return F.coalesce(_rendered(part, F.coalesce(surrogate, F.lit(""))), part["raw"])

    alone = F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), F.array_join(F.reverse(F.array_sort("names")), "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    inner = F.transform("pieces", lambda x, i: F.when(i % 2 == 1, F.array(F.lit(""), x)).when(F.size("names") > 0, F.split(F.regexp_replace(x, alone, F.lit(f"{MARK}$0{MARK}")), MARK, -1)).otherwise(F.array(x)))
    made = joined.select("row", "pieces", "known", inner.alias("inner"))
    name_of = lambda x: F.struct(F.lit("surname").alias("type"), x.alias("raw"))
    whole = lambda x: F.array_join(F.transform(parts_of(x), shown), " ")
    out = F.transform("inner", lambda xs, i: F.array_join(F.transform(xs, lambda x, j: F.when(j % 2 == 0, x).when(i % 2 == 1, whole(x)).otherwise(shown(name_of(x)))), ""))
    new = F.replace(F.replace(F.array_join(out, ""), F.lit(APART + "1"), F.lit(MARK)), F.lit(APART + "0"), F.lit(APART))
    count = F.aggregate("inner", F.lit(0), lambda a, xs: a + F.floor(F.size(xs) / 2).cast("int"))
    return quiet.unionByName(made.select(*((new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names), *more(count)))
