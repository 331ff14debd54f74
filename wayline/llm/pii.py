"""Personal data: validated numbers and dates become keyed permutations of their own format.

One alternation finds candidates; each is validated by its kind's rules (check digits,
ranges, calendar) and left alone if it fails.  Cards and IBANs have other digits or words
beside them, so runs of words are searched for the valid ones and these are marked first.
The digits of a valid one name a number of
a domain Z_a x Z_b (all valid dates of 400 years, all North American phone numbers, ...),
which an unbalanced Feistel network with a keyed round function permutes; the result is
written in the same format, with check digits renewed.  Equal values thus have equal
pseudonyms in all documents, whatever separators they are written with.  Mail addresses
and secrets aren't numbers: they become keyed digests.

Only DataFrame functions; no value leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Setting that holds the key; without it the queries, which read made data, take the example key.
KEY_SETTING = "spark.wayline.pseudonymKey"
EXAMPLE_KEY = "wayline-example-key"
#: Rounds of each half.
ROUNDS = 4

_L, _R = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Kinds in the order in which the alternation tries them.
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^\-]++|-(?!----END [A-Z ]{0,30}PRIVATE KEY-----))*+-----END [A-Z ]{0,30}PRIVATE KEY-----",
    # The whole host, however many labels, where it ends in letters; else as far as one that does.
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)*+(?<=\.\p{L}{2,63})|(?:[\p{L}\p{N}\-]{1,63}\.){1,63}\p{L}{2,63})",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[^\s\"']{8,}",
    "token": _L + r"(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_\-]{12,}|xox[a-z]-[A-Za-z0-9\-]{10,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})" + _R,
    "iban": _L + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _R,
    "date": _L + r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})" + _R,
    "ip": r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+1[ .\-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .\-])[2-9]\d{2}[ .\-]\d{4}(?![\p{L}\p{N}]|-\d)",
    "intl_phone": r"(?<![\p{L}\p{N}+])\+[1-9]\d{0,2}(?:[ .\-]?\(?\d{2,4}\)?){2,5}(?![\p{L}\p{N}]|-\d)",
    "card": r"(?<![\p{L}\p{N}\-])\d(?:[ \-]?\d){12,18}(?![\p{L}\p{N}]|-\d)",
}
#: Words of digits, or from the start of an IBAN on, with single separators: cards and IBANs are windows of them.
_END = r"(?![\p{L}\p{N}])"
RUNS = {
    "iban": _L + rf"[A-Z]{{2}}\d{{2}}[A-Z0-9]*+{_END}(?:[ \-][A-Z0-9]++{_END})*+",
    "card": rf"(?<![\p{{L}}\p{{N}}\-])(?=\d(?:[ \-]?\d){{12}})\d++{_END}(?:[ \-]\d++{_END})*+",
}
#: Stands before and after each card and IBAN found in a run; a noncharacter, and escaped where a text holds it.
MARK, _ESCAPE, _SELF, _MARKED = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
FIRST = "|".join((PATTERNS | RUNS).values())
ANY = "|".join([f"{MARK}[A-Z0-9 \\-]+{MARK}", *[p for k, p in PATTERNS.items() if k not in RUNS]])
_CARD, _IBAN = r"^\d(?:[ \-]?\d){12,18}$", r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"
#: Printed cards have words of four digits or more, but for the last.
_PRINTED = r"^(?:\d{4,}[ \-])*\d+$"
#: Other kinds that a run's words can form; cards don't start within them.
_OTHER = r"^(?:\d{4}-\d{2}-\d{2}|\d{3}-\d{2}-\d{4}|[2-9]\d{2}[ \-][2-9]\d{2}[ \-]\d{4})$"
_MOST_WORDS = 19
#: A match of the first search that may hold cards or IBANs among other words.
_IN_RUN = r"^(?=[\s\S]{13})(?=(?:\D{0,3}\d){13}|[A-Z]{2}\d{2})\+?[A-Z0-9]+(?:[ .\-]?[A-Z0-9()]+)*+$"
#: A text without any of these holds no candidate.
HINT = r"[0-9@]|PRIVATE KEY|(?i:passw|pwd|secret|token|api|access)"
_DAYS_A, _DAYS_B, _EPOCH = 189, 773, "1800-01-01"  # 189 * 773 days are the 400 years from then


def _round(key: str, tag: str, n: Column, x: Column, below: Column) -> Column:
    """A number in [0, below) that key, tag, round number and x determine."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), n.cast("string"), x.cast("string"), below.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % below


def feistel(key: str, tag: str, x: Column, a, b) -> Column:
    """A permutation of [0, a * b); x, a and b are longs."""
    a, b = (v.cast("long") if isinstance(v, Column) else F.lit(v).cast("long") for v in (a, b))
    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"), a.alias("a"), b.alias("b"))

    def step(s: Column, n: Column) -> Column:
        left = (s["l"] + _round(key, tag, n, s["r"], s["a"])) % s["a"]
        return F.struct(left.alias("l"), s["r"].alias("r"), s["a"].alias("a"), s["b"].alias("b"))

    def other(s: Column, n: Column) -> Column:
        right = (s["r"] + _round(key, tag, n, s["l"], s["b"])) % s["b"]
        return F.struct(s["l"].alias("l"), right.alias("r"), s["a"].alias("a"), s["b"].alias("b"))

    rounds = F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1))
    return F.aggregate(rounds, start, lambda s, n: F.when(n % 2 == 0, step(s, n)).otherwise(other(s, n)), lambda s: s["l"] * s["b"] + s["r"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _permute_digits(key: str, tag: str, d: Column) -> Column:
    """A string of 1 to 18 digits, permuted among those of its length."""
    n = F.length(d)
    half = F.floor(n / 2).cast("int")
    return F.lpad(feistel(key, tag, d.cast("long"), F.pow(F.lit(10), half).cast("long"), F.pow(F.lit(10), n - half).cast("long")).cast("string"), n, "0")


def _put(m: Column, d: Column) -> Column:
    """``m`` with its digits replaced by those of ``d``, in order."""
    done = F.aggregate(
        F.split(m, ""),
        F.struct(F.lit("").alias("t"), F.lit(1).alias("k")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["t"], F.substr(d, s["k"], F.lit(1))).alias("t"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["k"].alias("k"))),
        lambda s: s["t"],
    )
    return done


def _luhn_sum(d: Column, double_last: bool) -> Column:
    """Luhn sum of a digit string; ``double_last``: the last digit is one of those doubled."""
    n = F.length(d)
    each = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.substr(d, k, F.lit(1)).cast("int").alias("v"), ((n - k) % 2 == (0 if double_last else 1)).alias("x")))
    return F.aggregate(each, F.lit(0), lambda s, e: s + F.when(~e["x"], e["v"]).when(e["v"] > 4, 2 * e["v"] - 9).otherwise(2 * e["v"]))


def _mod97(s: Column) -> Column:
    """Remainder of an IBAN's letters and digits (letters as 10 to 35)."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda r, c: F.when(value(c) > 9, (r * 100 + value(c)) % 97).otherwise((r * 10 + value(c)) % 97))


def _month_first(m: Column) -> Column:
    return F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)).try_cast("date")


def _date_of(m: Column) -> Column:
    """Slashes are read month first and, if that is no date, day first."""
    iso = F.when(m.rlike(r"^\d{4}"), F.concat_ws("-", F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2)))
    us = F.when(m.contains("/"), _month_first(m))
    day_first = F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)).try_cast("date")
    return F.when(iso.isNotNull(), iso.try_cast("date")).otherwise(F.coalesce(us, day_first))


def _whole(pattern: str) -> str:
    return rf"^(?:{pattern})$"


def _valid_iban(m: Column) -> Column:
    letters = F.regexp_replace(m, " ", "")
    return _mod97(F.concat(F.substr(letters, F.lit(5)), F.substring(letters, 1, 4))) == 1


def _valid_card(m: Column) -> Column:
    d = _digits(m)
    return (_luhn_sum(d, False) % 10 == 0) & ~d.rlike("^0+$")


def _mark(x: Column) -> Column:
    """A run with marks around its valid cards and IBANs: at each word the longest, else the next word is tried.

    Of cards, all windows of words that a card may be printed in count, and the longest
    window from where the last one failed, however its digits are grouped.
    """
    words = F.split(x, r"(?<=[ \-])")

    def step(s: Column, i: Column) -> Column:
        def window(j: Column) -> Column:
            return F.regexp_replace(F.array_join(F.slice(s["w"], i + 1, j - i + 1), ""), r"[ \-]$", "")

        start = F.get(s["w"], i)
        ends = F.transform(F.sequence(i, F.least(i + _MOST_WORDS - 1, F.size(s["w"]) - 1)), lambda j: F.struct(j.alias("j"), window(j).alias("t")))
        fits = F.filter(ends, lambda e: e["t"].rlike(_IBAN) | e["t"].rlike(_CARD) | e["t"].rlike(_OTHER))
        longest = F.array_max(F.transform(F.filter(fits, lambda e: e["t"].rlike(_CARD)), lambda e: e["j"]))
        good = F.filter(
            fits,
            lambda e: F.when(e["t"].rlike(_OTHER), True).when(e["t"].rlike(_CARD), (e["t"].rlike(_PRINTED) | ((i >= s["chunk"]) & (e["j"] == longest))) & _valid_card(e["t"])).otherwise(_valid_iban(e["t"])),
        )
        best = F.element_at(good, -1)
        chunk = F.when(i >= s["chunk"], F.coalesce(longest + 1, i + 1)).otherwise(s["chunk"])
        plain = F.struct(s["w"].alias("w"), F.concat(s["out"], start).alias("out"), (i + 1).alias("next"), chunk.alias("chunk"))
        taken = F.array_join(F.slice(s["w"], i + 1, best["j"] - i + 1), "")
        gap = F.substr(taken, F.length(best["t"]) + 1)
        whole = F.when(best["t"].rlike(_OTHER), taken).otherwise(F.concat(F.lit(MARK), best["t"], F.lit(MARK), gap))
        found = F.struct(s["w"].alias("w"), F.concat(s["out"], whole).alias("out"), (best["j"] + 1).alias("next"), (best["j"] + 1).alias("chunk"))
        return F.when(i < s["next"], s).when(~start.rlike(r"^(?:\d|[A-Z]{2}\d{2})") | (F.size(good) == 0), plain).otherwise(found)

    begin = F.struct(words.alias("w"), F.lit("").alias("out"), F.lit(0).alias("next"), F.lit(0).alias("chunk"))
    return F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), begin, step, lambda s: s["out"])


def kind_of(m: Column) -> Column:
    """The kind of a candidate that is valid, else null."""
    d = _digits(m)
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("int"))
    day = F.datediff(_date_of(m), F.lit(_EPOCH).cast("date"))
    return (
        F.when(m.startswith("-----BEGIN"), "private_key")
        .when(m.contains("@") & m.rlike(_whole(PATTERNS["email"])), "email")
        .when(m.rlike(_whole(PATTERNS["secret"])), "secret")
        .when(m.rlike(_whole(PATTERNS["token"])), "token")
        .when(m.rlike(_whole(PATTERNS["iban"])), F.when(_valid_iban(m), "iban"))
        .when(m.rlike(_whole(PATTERNS["date"])), F.when((day >= 0) & (day < _DAYS_A * _DAYS_B), "date"))
        .when(m.rlike(_whole(PATTERNS["ip"])), F.when(F.forall(octets, lambda o: o <= 255), "ip"))
        .when(m.rlike(_whole(PATTERNS["ssn"])), F.when(~d.rlike(r"^(?:000|666|9)|^\d{3}00|0000$"), "ssn"))
        .when(m.rlike(_whole(PATTERNS["phone"])), "phone")
        .when(m.rlike(_whole(PATTERNS["intl_phone"])), F.when(F.length(d).between(8, 15), "intl_phone"))
        .when(m.rlike(_whole(PATTERNS["card"])), F.when(_valid_card(m), "card"))
    )


def pseudonym(key: str, m: Column, kind: Column) -> Column:
    """The replacement of a valid candidate."""
    d = _digits(m)
    tag = lambda t, x: F.sha2(F.concat_ws("|", F.lit(key), F.lit(t), x), 256)
    num = lambda s: s.cast("long")
    # Phones: area and exchange codes start at 200, the line has four digits; a country code stays.
    local = F.substr(d, F.length(d) - 9, F.lit(10))
    p = feistel(key, "phone", (num(F.substring(local, 1, 3)) - 200) * 8_000_000 + (num(F.substring(local, 4, 3)) - 200) * 10_000 + num(F.substring(local, 7, 4)), 800, 8_000_000)
    phone = F.concat(F.substr(d, F.lit(1), F.length(d) - 10), (F.floor(p / 8_000_000) + 200).cast("string"), (F.floor(p / 10_000) % 800 + 200).cast("string"), F.lpad((p % 10_000).cast("string"), 4, "0"))
    intl = F.concat(F.substring(d, 1, 2), _permute_digits(key, "intl", F.substr(d, F.lit(3))))
    # Cards: the first digit (the network) stays, the last is the check digit of the others.
    body = F.concat(F.substring(d, 1, 1), _permute_digits(key, "card", F.substr(d, F.lit(2), F.length(d) - 2)))
    card = F.concat(body, ((10 - _luhn_sum(body, True) % 10) % 10).cast("string"))
    # Social security numbers: areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999.
    area = num(F.substring(d, 1, 3))
    s = feistel(key, "ssn", (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + num(F.substring(d, 4, 2)) - 1) * 9999 + num(F.substring(d, 6, 4)) - 1, 898, 99 * 9999)
    a = F.floor(s / (99 * 9999))
    ssn = F.concat(F.lpad((F.when(a >= 665, a + 2).otherwise(a + 1)).cast("string"), 3, "0"), F.lpad((F.floor(s / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((s % 9999 + 1).cast("string"), 4, "0"))
    o = lambda k: F.split(m, r"\.")[k].cast("long")
    i = feistel(key, "ip", ((o(0) * 256 + o(1)) * 256 + o(2)) * 256 + o(3), 65536, 65536)
    ip = F.concat_ws(".", *[(F.floor(i / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)])
    day = F.date_add(F.lit(_EPOCH).cast("date"), feistel(key, "date", F.datediff(_date_of(m), F.lit(_EPOCH).cast("date")).cast("long"), _DAYS_A, _DAYS_B).cast("int"))
    y, mo, da = F.lpad(F.year(day).cast("string"), 4, "0"), F.lpad(F.month(day).cast("string"), 2, "0"), F.lpad(F.day(day).cast("string"), 2, "0")
    date = F.when(m.rlike(r"^\d{4}-"), F.concat_ws("-", y, mo, da)).when(m.rlike(r"^\d{4}/"), F.concat_ws("/", y, mo, da)).when(m.contains("/"), F.when(_month_first(m).isNotNull(), F.concat_ws("/", mo, da, y)).otherwise(F.concat_ws("/", da, mo, y))).otherwise(F.concat_ws(".", da, mo, y))
    # IBANs: the last digits of the account, 18 at most, are permuted; letters and bank stay; check digits are renewed.
    plain = F.regexp_replace(m, " ", "")
    account = F.substr(plain, F.lit(5))
    ad = _digits(account)
    keep = F.greatest(F.length(ad) - 18, F.lit(0))
    moved = _put(account, F.concat(F.substr(ad, F.lit(1), keep), F.when(F.length(ad) > 0, _permute_digits(key, "iban", F.substr(ad, keep + 1))).otherwise("")))
    renewed = F.concat(F.substring(plain, 1, 2), F.lpad((98 - _mod97(F.concat(moved, F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, "0"), moved)
    gaps = F.aggregate(
        F.split(m, ""),
        F.struct(F.lit("").alias("t"), F.lit(1).alias("k")),
        lambda q, c: F.when((c == " ") | (c == ""), F.struct(F.concat(q["t"], c).alias("t"), q["k"].alias("k"))).otherwise(F.struct(F.concat(q["t"], F.substr(renewed, q["k"], F.lit(1))).alias("t"), (q["k"] + 1).alias("k"))),
        lambda q: q["t"],
    )
    mail = F.lower(m)
    email = F.concat(F.lit("user-"), F.substring(tag("mail", F.substring_index(mail, "@", 1)), 1, 16), F.lit("@host-"), F.substring(tag("host", F.substring_index(mail, "@", -1)), 1, 16), F.lit(".invalid"))
    value = F.regexp_extract(m, r"^(?s:.*?[=:]\s{0,3}[\"']?)([^\s\"']+)$", 1)
    secret = F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), F.lit("SECRET-"), F.substring(tag("secret", value), 1, 16))
    return (
        F.when(kind == "email", email)
        .when(kind == "secret", secret)
        .when(kind == "token", F.concat(F.lit("TOKEN-"), F.substring(tag("secret", m), 1, 16)))
        .when(kind == "private_key", F.concat(F.lit("PRIVATE-KEY-"), F.substring(tag("secret", m), 1, 16)))
        .when(kind == "iban", gaps)
        .when(kind == "date", date)
        .when(kind == "ip", ip)
        .when(kind == "ssn", _put(m, ssn))
        .when(kind == "phone", _put(m, phone))
        .when(kind == "intl_phone", _put(m, intl))
        .when(kind == "card", _put(m, card))
    )


def configured_key(spark: SparkSession) -> str:
    """The key that the session is given, or the example key."""
    return spark.conf.get(KEY_SETTING, None) or EXAMPLE_KEY


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = "pii") -> DataFrame:
    """``docs`` with personal data replaced in ``text_col``, and ``found_col``: array of (kind, pseudonym) in order of place.

    A null text stays null and an empty one empty; candidates that fail validation stay as
    they are; repeated rows come out equal; the other columns are kept (``found_col`` must
    be a new name, or None to leave it out).  ``key`` has no default: see :func:`configured_key`.
    """
    if found_col in docs.columns:
        raise ValueError(f"{found_col} is a column already")
    own = "_wl"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    t, m, f, cut = own + "text", own + "found", own + "pairs", own + "parts"
    text = F.col(text_col).cast("string")
    swap = lambda c, *pairs: swap(F.replace(c, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:]) if pairs else c
    hit = docs.withColumn(t, F.when(text.rlike(f"[{MARK}{_ESCAPE}]"), swap(text, (_ESCAPE, _ESCAPE + _SELF), (MARK, _ESCAPE + _MARKED))).otherwise(text))
    runs = hit.withColumn(m, F.when(F.col(t).rlike(HINT), F.regexp_extract_all(t, F.lit(FIRST), 0)))
    runs = runs.withColumn(cut, F.when(F.exists(m, lambda x: x.rlike(_IN_RUN)), F.split(t, FIRST, -1)))
    marked = F.concat(F.array_join(F.zip_with(F.slice(cut, 1, F.size(m)), m, lambda p, x: F.concat(p, F.when(x.rlike(_IN_RUN), _mark(x)).otherwise(x))), ""), F.element_at(cut, -1))
    runs = runs.withColumn(t, F.when(F.col(cut).isNotNull(), marked).otherwise(F.col(t)))
    hit = runs.withColumn(m, F.when(F.size(m) > 0, F.regexp_extract_all(t, F.lit(ANY), 0)))
    clean = lambda x: F.replace(x, F.lit(MARK), F.lit(""))
    named = hit.withColumn(f, F.when(F.size(m) > 0, F.transform(F.transform(m, clean), lambda x: F.struct(x.alias("m"), kind_of(x).alias("kind")))))
    valued = named.withColumn(f, F.transform(f, lambda x: F.struct(x["kind"].alias("kind"), F.when(x["kind"].isNull(), x["m"]).otherwise(pseudonym(key, x["m"], x["kind"])).alias("pseudonym"))))
    parts = valued.withColumn(cut, F.when(F.col(f).isNotNull(), F.split(t, ANY, -1)))
    joined = F.concat(F.array_join(F.zip_with(F.slice(cut, 1, F.size(f)), f, lambda p, x: F.concat(p, x["pseudonym"])), ""), F.element_at(cut, -1))
    back = F.when(joined.contains(_ESCAPE), swap(clean(joined), (_ESCAPE + _MARKED, MARK), (_ESCAPE + _SELF, _ESCAPE))).otherwise(clean(joined))
    out = parts.withColumn(text_col, F.when(F.col(f).isNull(), F.col(text_col)).otherwise(back))
    if found_col:
        out = out.withColumn(found_col, F.coalesce(F.filter(f, lambda x: x["kind"].isNotNull()), F.array().cast("array<struct<kind:string,pseudonym:string>>")))
    return out.drop(t, m, f, cut)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = pseudonymize(docs, configured_key(spark))
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_found"), F.array_join(F.array_sort(F.transform("pii", lambda x: x["kind"])), ",").alias("kinds"))
