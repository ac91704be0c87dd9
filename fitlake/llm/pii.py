"""Format-preserving pseudonyms by a keyed Feistel network, in DataFrame
operations only.

Numbers and dates that pass their kind's validation are permuted within their
format: a card number becomes another with a right check digit, a date another
date of the calendar, an address another address, with separators and grouping
kept.  The permutation depends on the key and the kind alone, so equal values
have equal pseudonyms in all documents and nothing is joined or shuffled.
Mail addresses keep their domain; the letters and digits of the local part are
permuted within their classes.

A value is a pair (x, y) of residues modulo (m, n); a round turns it into
(y, x + F(y) mod m) with F from SHA-256, and swaps the moduli.  Each round is
a bijection, whatever the moduli, so no value has to be walked back into its
domain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.llm.base import query, read

#: An even number, for the moduli to end as they began.
ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Patterns, in the order in which they are tried at a place.
# An address begins at the first letter or digit of its run of characters: the
# other places of a run, which end at the same "@" or at none, are not tried
# (but behind 64 marks, where the run's beginning is out of sight).
_MARK = "[._%+-]"
# (the domain's labels are possessive: the matcher's stack does not grow with them)
_LABELS = r"(?:(?![A-Za-z]{2})[A-Za-z0-9-]+\.)*+[A-Za-z]{2,}"
EMAIL = (rf"(?<![A-Za-z0-9])(?:(?<!{_MARK})|(?<=(?<![A-Za-z0-9._%+-]){_MARK}{{1,64}})|(?<={_MARK}{{64}}))"
         rf"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+\.{_LABELS}(?:[A-Za-z0-9-]*\.{_LABELS})*+")
DATE = (r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"
        r"|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![0-9]|[./-][0-9])")
IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
# with a country code (8 to 15 digits in any grouping), 3-3-4, or with a trunk zero
# Groups behind a country code are taken whole, the more the better; what stands behind the 15th digit is another value,
# and a card's digits are left together.  (Looked back at in nested options: Java sees no bound in a repeated group of
# varying length.)
_GROUPS = [rf"(?:[ .-]?\([0-9]{{1,5}}\)|(?:[ .-]|(?<=\)))[0-9]++){{{n}}}" for n in ("1,7", "0,6")]
_DIGIT = r"[ .()-]{0,3}[0-9]"


def _number(least: int) -> str:
    """Groups, `least` to 15 digits in all."""
    back = _DIGIT * least + reduce(lambda more, _: f"(?:{_DIGIT}{more})?", range(15 - least), "")
    return rf"(?:[0-9]{{1,3}}+(?![0-9]){_GROUPS[0]}|[0-9]{{2,15}}+{_GROUPS[1]})(?<=\+{back}\)?)(?![0-9]|[.-][0-9])"


PHONE = (r"(?:(?<![0-9])\+(?=(?:[ .()-]{0,2}[0-9]){8,15}(?![0-9]))"
         rf"(?:{_number(8)}(?:(?! \(?[0-9])|(?= (?:[0-9][ -]?){{12,18}}[0-9](?![0-9])))|{_number(2)})"
         r"|(?<![0-9.-])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
         r"|(?<![0-9.-])(?:\(0[0-9]{1,4}\)|0[0-9]{1,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4})(?![0-9]|[.-][0-9])")
#: Groups of digits that no other kind begins with, however many (possessive: the matcher's stack does not grow with
#: them); numbers that pass the check digit are sought in them.
CARD = (r"(?<![0-9])(?=(?:[0-9][ -]?){12}[0-9])[0-9]+"
        rf"(?:[ -](?!{EMAIL}|{DATE}|{IP}|{SSN}|{PHONE})[0-9]+(?![0-9]|[./][0-9]))*+(?![0-9])")
CARD_BLOCK = 500
KINDS = ("email", "date", "ip", "ssn", "phone", "card")
ALL = "|".join((EMAIL, DATE, IP, SSN, PHONE, CARD))
#: Days of the 400 years from 1800-01-01 on, as two residues: 189 * 773.
EPOCH, DAYS = "1800-01-01", (189, 773)


def _long(v) -> Column:
    return v.cast("long") if isinstance(v, Column) else F.lit(v).cast("long")


def feistel(key: str, tweak: Column | str, x, y, m, n) -> Column:
    """struct(x, y): the permuted residues x modulo m and y modulo n."""
    tweak = tweak if isinstance(tweak, Column) else F.lit(tweak)

    def turn(s, r):
        mac = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), s["m"].cast("string"),
                                 s["y"].cast("string")).cast("binary"), 256)
        f = F.conv(F.substring(mac, 1, 15), 16, 10).cast("long")
        return F.struct(s["y"].alias("x"), F.pmod(s["x"] + F.pmod(f, s["m"]), s["m"]).alias("y"),
                        s["n"].alias("m"), s["m"].alias("n"))

    start = F.struct(_long(x).alias("x"), _long(y).alias("y"), _long(m).alias("m"), _long(n).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _feistel_text(key: str, tweak: str, s: Column) -> Column:
    """ASCII letters and digits permuted, each position within its class."""
    half = F.floor(F.length(s) / 2).cast("int")

    def shifted(part: Column, other: Column, r: Column) -> Column:
        mac = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), r.cast("string"), other).cast("binary"), 512)

        def one(c: Column, i: Column, mac: Column) -> Column:
            f = F.conv(F.substr(mac, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 32).cast("int")
            at = lambda base, size: F.char((F.lit(base) + F.pmod(F.ascii(c) - base + f, F.lit(size))).cast("long"))
            return (F.when(c.between("0", "9"), at(48, 10)).when(c.between("a", "z"), at(97, 26))
                    .when(c.between("A", "Z"), at(65, 26)).otherwise(c))

        # the digest is looked at for each character: bound by a one-element array
        return F.get(F.transform(F.array(mac), lambda m: F.array_join(F.transform(
            F.filter(F.split(part, ""), lambda c: c != ""), lambda c, i: one(c, i, m)), "")), 0)

    start = F.struct(F.substr(s, F.lit(1), half).alias("a"), F.substr(s, half + 1).alias("b"))
    # odd rounds change the second half, even ones the first
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda t, r: F.when(
        r % 2 == 1, F.struct(t["a"].alias("a"), shifted(t["b"], t["a"], r).alias("b"))).otherwise(
        F.struct(shifted(t["a"], t["b"], r).alias("a"), t["b"].alias("b"))))
    return F.concat(end["a"], end["b"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _pour(s: Column, digits: Column) -> Column:
    """`s` with its digits replaced, in order."""
    end = F.aggregate(
        F.filter(F.split(s, ""), lambda c: c != ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda t, c: F.when(c.between("0", "9"), F.struct(
            F.concat(t["out"], F.substr(digits, t["at"], F.lit(1))).alias("out"), (t["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(t["out"], c).alias("out"), t["at"].alias("at"))))
    return end["out"]


def luhn_sum(digits: Column, first_doubled: int) -> Column:
    """Sum of digits from the right, each second one doubled (its digits
    added); `first_doubled` 2 for whole numbers, 1 for a payload."""
    def step(acc, i):
        v = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        two = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return acc + F.when(i % 2 == first_doubled % 2, two).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def _pad(v: Column, n) -> Column:
    return F.lpad(v.cast("string"), n if isinstance(n, int) else n, "0")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _card(key: str, s: Column) -> Column:
    d = _digits(s)
    payload = F.substr(d, F.lit(1), F.length(d) - 1)
    left = F.floor(F.length(payload) / 2).cast("int")
    right = F.length(payload) - left
    p = feistel(key, F.concat(F.lit("card"), F.length(d).cast("string")), F.substr(payload, F.lit(1), left),
                F.substr(payload, left + 1), _power(left), _power(right))
    # p is looked at twice and the new payload again: bound by one-element arrays
    new = F.transform(F.array(p), lambda q: F.concat(_pad(q["x"], left), _pad(q["y"], right)))
    new = F.transform(new, lambda q: F.concat(q, F.pmod(F.lit(10) - luhn_sum(q, 1) % 10, F.lit(10)).cast("string")))
    return F.when(luhn_sum(d, 2) % 10 == 0, _pour(s, F.get(new, 0)))


def _cards(key: str, s: Column) -> Column:
    """struct(new, n): runs of whole groups with 13 to 19 digits and a right
    check digit replaced, leftmost first, then longest."""
    both = F.struct(F.regexp_extract_all(s, F.lit("([0-9]+)"), 1).alias("groups"),
                    F.regexp_extract_all(s, F.lit("([ -]?[0-9]+)"), 1).alias("pieces"))

    def step(t, i, groups, pieces):
        digits = lambda j: F.array_join(F.slice(groups, i + 1, j - i + 1), "")
        ends = F.filter(F.sequence(i, F.least(i + 18, F.size(groups) - 1)),
                        lambda j: F.length(digits(j)).between(13, 19) & (luhn_sum(digits(j), 2) % 10 == 0))
        found = F.transform(F.array(F.array_max(ends)), lambda j: F.when(j.isNull(), F.struct(
            F.concat(t["out"], F.get(pieces, i)).alias("out"), (i + 1).alias("upto"), t["n"].alias("n"))).otherwise(F.struct(
                F.concat(t["out"], _card(key, F.array_join(F.slice(pieces, i + 1, j - i + 1), ""))).alias("out"),
                (j + 1).alias("upto"), (t["n"] + 1).alias("n"))))
        return F.when(i < t["upto"], t).otherwise(F.get(found, 0))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("upto"), F.lit(0).alias("n"))

    # the text is put together in blocks of groups, so that each step copies a
    # block's text and not the whole
    def block(t, lo, b):
        here = F.aggregate(F.sequence(lo, F.least(lo + CARD_BLOCK - 1, F.size(b["groups"]) - 1)),
                           F.struct(F.lit("").alias("out"), t["upto"].alias("upto"), t["n"].alias("n")),
                           lambda u, i: step(u, i, b["groups"], b["pieces"]))
        return F.get(F.transform(F.array(here), lambda u: F.struct(
            F.concat(t["out"], u["out"]).alias("out"), u["upto"].alias("upto"), u["n"].alias("n"))), 0)

    # both lists are looked at for each group: bound by a one-element array
    return F.get(F.transform(F.array(both), lambda b: F.aggregate(
        F.sequence(F.lit(0), F.size(b["groups"]) - 1, F.lit(CARD_BLOCK)), start, lambda t, lo: block(t, lo, b))), 0)


def _phone(key: str, s: Column) -> Column:
    """The country code (what stands before the last 10 digits if it is not set
    apart) or trunk zero stays."""
    d = _digits(s)
    first = F.length(F.regexp_extract(s, r"^\+([0-9]{1,3})(?![0-9])", 1))
    kept = (F.when(s.startswith("+"), F.when(first > 0, first).otherwise(F.least(F.lit(3), F.greatest(F.lit(1), F.length(d) - 10))))
            .when(s.rlike(r"^\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$"), 0).otherwise(1))
    code, rest = F.substr(d, F.lit(1), kept), F.substr(d, kept + 1)
    left = F.floor(F.length(rest) / 2).cast("int")
    right = F.length(rest) - left
    tweak = F.when(F.length(rest) == 10, F.lit("phone")).otherwise(F.concat(F.lit("phone"), F.length(rest).cast("string")))
    p = feistel(key, tweak, F.substr(rest, F.lit(1), left), F.substr(rest, left + 1), _power(left), _power(right))
    return F.get(F.transform(F.array(p), lambda q: _pour(s, F.concat(code, _pad(q["x"], left), _pad(q["y"], right)))), 0)


def _ip(key: str, s: Column) -> Column:
    o = F.transform(F.split(s, r"\."), lambda v: v.cast("long"))
    p = feistel(key, "ip", F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), 65536, 65536)
    low = lambda v: v.bitwiseAND(F.lit(255)).cast("string")
    return F.get(F.transform(F.array(p), lambda q: F.concat_ws(
        ".", F.shiftright(q["x"], 8).cast("string"), low(q["x"]), F.shiftright(q["y"], 8).cast("string"), low(q["y"]))), 0)


def _ssn(key: str, s: Column) -> Column:
    o = F.transform(F.split(s, "-"), lambda v: v.cast("long"))
    area = F.get(o, 0) - 1 - F.when(F.get(o, 0) > 666, 1).otherwise(0)
    p = feistel(key, "ssn", area, (F.get(o, 1) - 1) * 9999 + F.get(o, 2) - 1, 898, 99 * 9999)
    return F.get(F.transform(F.array(p), lambda q: F.concat_ws(
        "-", _pad(q["x"] + 1 + F.when(q["x"] >= 665, 1).otherwise(0), 3),
        _pad(F.floor(q["y"] / 9999) + 1, 2), _pad(q["y"] % 9999 + 1, 4))), 0)


def _date(key: str, s: Column) -> Column:
    def of(fmt: str) -> Column:
        days = F.datediff(F.try_to_date(s, fmt), F.lit(EPOCH).cast("date"))
        p = feistel(key, "date", F.floor(days / DAYS[1]), days % DAYS[1], *DAYS)
        back = F.transform(F.array(p), lambda q: F.date_format(
            F.date_add(F.lit(EPOCH).cast("date"), (q["x"] * DAYS[1] + q["y"]).cast("int")), fmt))
        return F.when(days.between(0, DAYS[0] * DAYS[1] - 1), F.get(back, 0))

    two = lambda wide, short: F.when(s.rlike("(?<![0-9])[0-9](?![0-9])"), of(short)).otherwise(of(wide))
    return (F.when(s.rlike("^[0-9]{4}-"), two("yyyy-MM-dd", "yyyy-M-d"))
            .when(s.rlike("^[0-9]{4}/"), two("yyyy/MM/dd", "yyyy/M/d")).when(s.contains("."), two("dd.MM.yyyy", "d.M.yyyy"))
            .when(s.contains("/"), F.coalesce(two("MM/dd/yyyy", "M/d/yyyy"), two("dd/MM/yyyy", "d/M/yyyy")))
            .otherwise(two("dd-MM-yyyy", "d-M-yyyy")))


def _email(key: str, s: Column) -> Column:
    local, domain = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    return F.concat(_feistel_text(key, "email", local), F.lit("@"), domain)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """`docs`, all rows and columns, with pseudonyms in `text` (n_chars, if
    there, is as before: formats keep their lengths but for addresses of
    numbers, so it is set anew) and the counts n_email, n_date, n_ip, n_ssn,
    n_phone, n_card of values replaced (columns of these names are replaced).

    Values that fail their validation (check digit, calendar, range) stay.  A
    null text stays null with counts 0; an empty one has none.  Repeated rows
    are treated alike; an empty table gives no rows.
    """
    def one(s: Column) -> Column:
        # the tests look at the value alone, without what stands around it
        is_ = lambda p: s.rlike(f"^(?:{p})$")
        kind = (F.when(s.contains("@"), F.lit("email")).when(is_(DATE), F.lit("date")).when(is_(IP), F.lit("ip"))
                .when(is_(SSN), F.lit("ssn")).when(is_(PHONE), F.lit("phone")).otherwise(F.lit("card")))
        made = F.transform(F.array(kind), lambda k: F.struct(k.alias("kind"), reduce(
            lambda w, x: w.when(k == x[0], x[1](key, s)),
            zip(KINDS[1:-1], (_date, _ip, _ssn, _phone)), F.when(k == "email", _email(key, s))).alias("new"),
            F.when(k == "card", _cards(key, s)).alias("cards")))
        return F.transform(made, lambda m: F.struct(
            F.when(m["new"].isNotNull() | (m["cards"]["n"] > 0), m["kind"]).alias("kind"),
            F.coalesce(m["new"], m["cards"]["out"], s).alias("new"), F.coalesce(m["cards"]["n"], F.lit(1)).alias("n")))

    maybe = F.col("text").rlike(r"[0-9@]")
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), "text")
    d = d.withColumn("_found", F.when(maybe, F.flatten(F.transform(
        F.regexp_extract_all("text", F.lit(f"({ALL})"), 1), one))))
    d = d.withColumn("_new", F.when(F.size("_found") > 0, F.array_join(F.zip_with(
        F.split("text", ALL, -1), "_found", lambda gap, f: F.concat(gap, F.coalesce(f["new"], F.lit("")))), ""))
        .otherwise(F.col("text")))
    counts = {f"n_{k}": F.aggregate(F.filter("_found", lambda f: f["kind"] == k), F.lit(0).cast("long"), lambda t, f: t + f["n"])
              for k in KINDS}
    counts = {n: F.when(F.col("_found").isNull(), F.lit(0).cast("long")).otherwise(c) for n, c in counts.items()}
    cols = [F.col("_new").alias(c) if c == "text"
            else F.length("_new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
            else F.col("_row")[c].alias(c) for c in docs.columns if c not in counts]
    return d.select(*cols, *[c.alias(n) for n, c in counts.items()])


#: The key of the query; users bring their own.
QUERY_KEY = "public example key"


@query("op10_pii_pseudonyms")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(read(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
