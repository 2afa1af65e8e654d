"""Secret scans: base patterns, and a battery of randomness tests with false-discovery control (native).

Base spans come from three fixed patterns. The method then looks at every other long run of token characters that is
not inside a base span. The encoding is inferred from the characters used; for each token three tests ask whether it
looks like drawn characters or like written words:

* chi-squared over the encoding's ``k`` symbols: drawn characters give ``k - 1`` on average, written ones as much more as
  their uneven use of these symbols makes;
* runs of character classes (lower, upper, digit, other; low and high digits in decimal), which written tokens change
  seldom;
* serial correlation of neighbours: the share of which just one is a vowel, and in decimal and hex the share whose codes
  differ by one at most; both are high in written tokens and low in drawn ones.

What drawn and written tokens give is taken from the encoding (:func:`expected`); a test in which drawn characters of an
encoding do not stand out from written ones (runs, where there is one class) has no say. Each test gives the probability
that a *written* token looks this random. They are combined by Fisher's method, weighted by length (a long token carries more evidence, so it gets more of the error budget), and the weighted
Benjamini-Hochberg step-up over all tokens of the corpus bounds the expected share of wrong finds at ``fdr``. The
step-up needs each p-value's rank only, so p-values are counted in fixed logarithmic bins (at most ``BINS`` rows).

Positions are code points, ends exclusive. Defined results: a null or empty text has no spans; repeated rows are
scanned each on its own; ties do not matter, as equal p-values fall together; no rows give no rows. Any other columns
pass through :func:`redact` unchanged and are not read by :func:`scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import free_name, materialize

# fixed values: the base patterns; letters of the keywords count in either case
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # runs below 24 characters fail in any case
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
ASSIGN_MIN, ACCESS_MIN = 6, 20
BINS, BIN_WIDTH = 4096, 0.05
#: Written tokens: chance of a class change between neighbours; Simpson index of letters in words; share of vowel changes
#: or of near codes; variance of a symbol's share, for that Simpson index.
WORD_CHANGE, WORD_SIMPSON, WORD_VOWEL, WORD_VARIANCE = 0.12, 0.075, 0.62, 0.0009
LOWER, UPPER, DIGITS, VOWELS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "aeiouy"
#: fixed values: encodings, the first that fits counts: pattern, and symbols by class
ENCODINGS = {
    "decimal": ("^[0-9]+$", ("01234", "56789")),
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", (DIGITS, "abcdef")),
    "base32": ("^[A-Z2-7]+=*$", (UPPER, "234567")),
    "letters": ("^([a-z]+|[A-Z]+)$", (LOWER,)),
    "base36": ("^([a-z0-9]+|[A-Z0-9]+)$", (LOWER, DIGITS)),
    "base64": ("", (LOWER, UPPER, DIGITS, "+/")),
}
NUMBERS = ("decimal", "hex")
SPAN = "array<struct<kind:string,start:int,end:int>>"


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches: pieces between matches and matches alternate, so their lengths add up to the positions."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h"), h.alias("t")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,t:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        b = acc["at"] + x["g"]
        e = b + x["h"]
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(b.alias("start"), e.alias("end"), x["t"].alias("t")))).alias("out"))

    found = F.aggregate(lengths, start, step, lambda acc: acc["out"])
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["t"].alias("t")))


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int,t:string>>")


def _long_value(span: Column) -> Column:
    return F.length(F.regexp_extract(span["t"], ASSIGN, 2)) >= ASSIGN_MIN


def base_spans(text: Column) -> Column:
    """Base spans of ``text``, by start, then kind as listed."""
    assign = F.when(text.rlike(ASSIGN), F.filter(_spans(text, ASSIGN, "assign"), _long_value)).otherwise(_none())
    access = F.when(
        text.contains("AKIA"), F.filter(_spans(text, ACCESS, "access"), lambda s: s["end"] - s["start"] >= ACCESS_MIN)
    ).otherwise(_none())
    hexes = F.when(text.rlike(HEX), _spans(text, HEX, "hex")).otherwise(_none())
    return F.concat(assign, access, hexes)


def _ordered(spans: Column) -> Column:
    rank = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("r"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _normal_upper(z: Column) -> Column:
    """P(Z > z): the rational bound of Zelen and Severo, good to 7.5e-8, and its tail form beyond."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2.0) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def _counts(token: Column, chars: Column) -> Column:
    """Sum over symbols of the squared count."""
    return F.aggregate(
        F.array_distinct(chars), F.lit(0.0),
        lambda acc, ch: acc + F.pow((F.length(token) - F.length(F.replace(token, ch, F.lit("")))).cast("double"), F.lit(2.0)),
    )


def _class(ch: Column) -> Column:
    return F.when(ch.between("a", "z"), 0).when(ch.between("A", "Z"), 1).when(ch.between("0", "9"), 2).otherwise(3)


def expected(encoding: str) -> tuple[int, float, bool, bool]:
    """Of an encoding: its number of symbols, the Simpson index of written tokens, and whether runs and serial tests tell.

    Written tokens are as uneven over any alphabet as words are over 26 letters; words stay words among more symbols.
    """
    classes = ENCODINGS[encoding][1]
    symbols = "".join(classes)
    k = len(symbols)
    change = 1.0 - sum((len(c) / k) ** 2 for c in classes)
    if encoding in NUMBERS:
        serial = sum(abs(i - j) <= 1 for i in range(k) for j in range(k)) / k**2
    else:
        vowels = sum(ch.lower() in VOWELS for ch in symbols) / k
        serial = 2.0 * vowels * (1.0 - vowels)
    return k, max(WORD_SIMPSON, 26 * WORD_SIMPSON / k), change > WORD_CHANGE, serial < WORD_VOWEL


def battery(tokens: DataFrame, token: str = "t") -> DataFrame:
    """Adds encoding, chi2, and p (the combined probability that a written token looks this random)."""
    t = F.col(token)

    def kind(name: str) -> Column:
        k, simpson, runs, serial = expected(name)
        return F.struct(
            F.lit(name).alias("name"), F.lit(float(k)).alias("k"), F.lit(simpson).alias("simpson"),
            F.lit(runs).alias("runs"), F.lit(serial).alias("serial"), F.lit(name in NUMBERS).alias("number"),
        )

    *tried, last = ENCODINGS
    alphabet = kind(last)
    for name in reversed(tried):
        alphabet = F.when(t.rlike(ENCODINGS[name][0]), kind(name)).otherwise(alphabet)
    df = tokens.withColumns({"_c": F.split(t, ""), "_enc": alphabet})
    df = df.withColumns({"_n": F.length(t).cast("double"), "_s": _counts(t, F.col("_c"))})
    n, k, written = F.col("_n"), F.col("_enc")["k"], F.col("_enc")["simpson"]
    chi2 = k * F.col("_s") / n - n
    # drawn characters: k - 1 degrees of freedom; written ones: non-central, with the spread of a mean over pairs
    mean = (k - 1.0) + (n - 1.0) * (k * written - 1.0)
    variance = WORD_VARIANCE * F.pow(written / WORD_SIMPSON, F.lit(2.0))
    spread = k * (n - 1.0) * F.sqrt(2.0 * written * (1.0 - written) / (n * (n - 1.0)) + 4.0 * variance / n)
    p_uniform = _normal_upper((mean - chi2) / spread)
    pairs = F.arrays_zip(F.slice(F.col("_c"), F.lit(1), F.size("_c") - 1).alias("a"), F.slice(F.col("_c"), F.lit(2), F.size("_c") - 1).alias("b"))
    name, number = F.col("_enc")["name"], F.col("_enc")["number"]
    vowel = lambda ch: F.lower(ch).isin(*VOWELS)
    code = lambda ch: F.instr(F.lit(DIGITS + "abcdef"), F.lower(ch))
    sort = lambda ch: F.when(name == "decimal", (ch >= "5").cast("int")).otherwise(_class(ch))
    linked = lambda a, b: F.when(number, F.abs(code(a) - code(b)) <= 1).otherwise(vowel(a) != vowel(b))
    seen = F.aggregate(
        pairs, F.struct(F.lit(0.0).alias("runs"), F.lit(0.0).alias("linked")),
        lambda acc, x: F.struct(
            (acc["runs"] + (sort(x["a"]) != sort(x["b"])).cast("double")).alias("runs"),
            (acc["linked"] + linked(x["a"], x["b"]).cast("double")).alias("linked"),
        ),
    )
    df = df.withColumn("_seen", seen)
    m = n - 1.0
    p_runs = _normal_upper((F.col("_seen")["runs"] - 0.5 - m * WORD_CHANGE) / F.sqrt(m * WORD_CHANGE * (1 - WORD_CHANGE)))
    p_serial = _normal_upper((m * WORD_VOWEL - F.col("_seen")["linked"] - 0.5) / F.sqrt(m * WORD_VOWEL * (1 - WORD_VOWEL)))
    evidence = lambda p, tells: F.when(tells, -F.log(F.greatest(p, F.lit(1e-30)))).otherwise(0.0)
    runs, serial = F.col("_enc")["runs"], F.col("_enc")["serial"]
    x = evidence(p_uniform, F.lit(True)) + evidence(p_runs, runs) + evidence(p_serial, serial)
    # Fisher: twice x is chi-squared with two degrees of freedom for each test, whose tail is a short sum
    tests = 1 + runs.cast("int") + serial.cast("int")
    fisher = F.exp(-x) * (1.0 + F.when(tests >= 2, x).otherwise(0.0) + F.when(tests >= 3, x * x / 2.0).otherwise(0.0))
    # a token less even in its alphabet, or more linked, than written ones is no drawn one, whatever the rest says
    fisher = F.when((p_uniform > 0.5) | (serial & (p_serial > 0.5)), F.lit(1.0)).otherwise(fisher)
    out = df.withColumns({"encoding": name, "chi2": chi2, "p": fisher})
    return out.drop("_c", "_enc", "_n", "_s", "_seen")


def discoveries(tested: DataFrame, fdr: float) -> DataFrame:
    """Rows whose length-weighted p-value passes the step-up at ``fdr``. A bin is judged by its upper edge."""
    w = F.length("t").cast("double")
    mean = tested.agg(F.avg(w).alias("w")).first()["w"] or 1.0
    q = F.least(F.lit(1.0), F.greatest(F.col("p") * F.lit(mean) / w, F.lit(1e-80)))
    binned = tested.withColumn("_bin", F.least(F.lit(BINS - 1), F.floor(-F.log10(q) / BIN_WIDTH)).cast("int"))
    counts = sorted(((r[0], r[1]) for r in binned.groupBy("_bin").count().collect()), reverse=True)
    total, seen, cut = sum(c for _, c in counts), 0, BINS
    for b, c in counts:
        seen += c
        if 10 ** (-b * BIN_WIDTH) <= fdr * seen / total:
            cut = b
    return binned.where(F.col("_bin") >= cut).drop("_bin")


def _read(text: Column) -> tuple[Column, Column]:
    """Base spans of a text, and its other long tokens."""
    base = base_spans(text)
    long = F.when(text.rlike(TOKEN), _spans(text, TOKEN, "random")).otherwise(_none())
    return base, long


def _free(long: str, base: str) -> Column:
    return F.filter(long, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def _found(read: DataFrame, fdr: float) -> DataFrame:
    """(row, found) of the rows (row, long) whose tokens the tests take for drawn characters."""
    tokens = read.where(F.size("long") > 0).select("_row", F.explode("long").alias("s")).select("_row", "s", F.col("s")["t"].alias("t"))
    tested = materialize(battery(tokens).select("_row", "s", "t", "p"), "secrets-tested")
    # a row is one document, so what is gathered here is one text's own spans
    return discoveries(tested, fdr).groupBy("_row").agg(F.collect_set("s").alias("found"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.001) -> DataFrame:
    """(doc_id, base, found): spans as arrays of (start, r, end, kind), ordered; ``found`` is what the tests add."""
    base, long = _read(F.coalesce(F.col(text_col), F.lit("")))
    read = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), base.alias("base"), long.alias("long"))
    read = materialize(read.select("doc_id", "_row", "base", _free("long", "base").alias("long")), "secrets-read")
    out = read.join(_found(read, fdr), "_row", "left")
    return out.select("doc_id", _ordered(F.col("base")).alias("base"), _ordered(F.coalesce("found", _none())).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of :func:`scan`'s result."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "found"))).alias("spans"),
    )


def _masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with the ordered ``spans`` replaced; spans that overlap become one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.aggregate(spans, start, step, rest)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", fdr: float = 0.001) -> DataFrame:
    """``docs`` with every span of :func:`scan` in ``text_col`` replaced by ``mark``; all rows and columns stay.

    A null text stays null. A count of characters in a column ``n_chars`` follows the new text.
    """
    row, base, long = (free_name(docs, x) for x in ("row_key", "base_spans", "long_spans"))
    text = F.col(text_col)
    own = docs.withColumn(row, F.xxhash64(id_col, text_col))
    b, tokens = _read(F.coalesce(text, F.lit("")))
    own = own.withColumns({base: b, long: tokens}).withColumn(long, _free(long, base))
    read = materialize(own.where(F.size(long) > 0).select(F.col(row).alias("_row"), F.col(long).alias("long")), "secrets-long")
    found = _found(read, fdr).withColumnRenamed("_row", row).withColumnRenamed("found", free_name(docs, "found_spans"))
    extra = found.columns[1]
    # only texts with other long tokens can have finds, so only these meet them
    some = own.where(F.size(long) > 0).join(found, row, "left").withColumn(base, F.concat(base, F.coalesce(extra, _none()))).drop(extra)
    both = own.where(F.size(long) == 0).unionByName(some)
    out = both.withColumn(text_col, F.when(F.size(base) > 0, _masked(text, _ordered(F.col(base)), mark)).otherwise(text))
    out = out.select(*docs.columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length(text_col).cast(kind), F.col("n_chars")))
    return out
