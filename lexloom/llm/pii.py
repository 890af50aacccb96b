"""PII by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Fixed patterns with checks (the base) find seed entities. The two words before a seed are a
lexical pattern, as is one word that ends like a label (`:`, `=`, `#`). Patterns and the
identifier-like words (instances) they precede form a graph: a pattern scores the share of all
words that ever follow it in the corpus which are believed instances; an instance that is no
seed scores the noisy-or of its patterns; both are iterated. Words of instances that score high
are reported besides the base, without the punctuation around them. What could have been of a
base kind and failed its check counts against patterns and is not reported where it stands.

Positions come from splitting a text at a pattern's matches and adding up lengths, so they are
code points, and no text is searched twice from its start. Running sums and replacements go by
blocks of BLOCK elements, as a long array that grows by one element at a time would be copied
each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import shared_dir, stored

KINDS = ("email", "ip", "card", "phone", "context")

#: Base patterns: fixed values of the contract, in possessive form and started only where a match
#: can start (so that long runs take linear time and no stack); the matches are the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no valid match of the kind.
NEEDED = {"email": "contains(text, '@')", "ip": r"text rlike r'[0-9]\.[0-9]++\.[0-9]++\.[0-9]'", "card": r"text rlike r'[0-9](?:[\x20-]?[0-9]){13}'", "phone": "contains(text, '+')"}
_DIGITS = "regexp_replace(x.h, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": "forall(split(x.h, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(right(p, 3) as int), 0) <= 255)",
    "card": f"length({_DIGITS}) between 14 and 19 and "
    f"aggregate(transform(filter(split(reverse({_DIGITS}), ''), d -> d <> ''), (d, i) -> int(d) * (1 + i % 2) - if(i % 2 = 1 and int(d) > 4, 9, 0)), 0, (a, d) -> a + d) % 10 = 0",
    "phone": f"length({_DIGITS}) between 10 and 15",
}
#: Matches of a kind that its check can fail though they have the form of one. Each satisfies
#: NEEDED by itself, so they are the same whatever else the text holds.
FORM = {"ip": "true", "card": f"length({_DIGITS}) between 14 and 19"}
#: Words with a digit or an at sign. Those that can be identifiers have this many characters and
#: digits without the punctuation around them.
TOKEN, TOKEN_LENGTH, TOKEN_DIGITS = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", 6, 3
OPENING, CLOSING = "\"'(<[{", ".,;:!?)]}>\"'"
#: Rounds of scoring; distinct seeds a pattern needs; scores from which tokens are reported.
ROUNDS, SUPPORT, CONFIDENT, PRIOR = 3, 3, 0.7, 1.0
#: Patterns up to this many are broadcast against the corpus's words; more are joined by shuffle.
SMALL = 50_000
#: Elements of a block; characters of a gap that are read first for the words at its end.
BLOCK, TAIL = 128, 80


def _quoted(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'" if "\\" in s else "'" + s.replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body, in which name stands for the value, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str, op: str) -> str:
    """SQL: for each of the array's ints what op (of {0} and {1}) makes of 0 and all before it."""
    step = lambda t, x: f"concat({t}, array({op.format(f'element_at({t}, -1)', x)}))"
    blocks = f"transform(sequence(0, greatest(size(_v) - 1, 0), {BLOCK}), i -> slice(_v, i + 1, {BLOCK}))"
    firsts = f"aggregate(_b, array(0), (t, b) -> {step('t', f"aggregate(b, 0, (u, x) -> {op.format('u', 'x')})")})"
    within = f"slice(aggregate(b, array(f), (t, x) -> {step('t', 'x')}), 1, size(b))"
    return _let("_v", values, _let("_b", blocks, f"flatten(zip_with(_b, slice({firsts}, 1, size(_b)), (b, f) -> {within}))"))


def _matches(pattern: str, needed: str, keep: str, fields: str, also: str = "0") -> Column:
    """The matches for which keep holds, as structs: start s, end e and fields. These and keep are
    SQL over x.h, the match, and y, which is `also` over all matches x (array m) and its place i."""
    p = _quoted(pattern)
    found = f"filter(zip_with(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), (g, h) -> named_struct('g', g, 'h', h)), x -> x.h is not null)"
    starts = _running("transform(m, x -> length(x.g) + length(x.h))", "{0} + {1}")
    made = f"transform(m, (x, i) -> if({keep}, {_let('y', also, f"named_struct('s', element_at(at, i + 1) + length(x.g), 'e', element_at(at, i + 1) + length(x.g) + length(x.h), {fields})")}, null))"
    spans = _let("m", found, _let("at", starts, f"filter({made}, x -> x is not null)"))
    return F.expr(f"coalesce(if({needed}, {spans}, null), array())")


def base_matches(texts: DataFrame) -> DataFrame:
    """texts (with a column text) plus one array of valid spans (s, e) per base kind, and
    `failed`, the spans that a check dropped and that have the form of an entity."""
    for kind in KINDS[:4]:
        keep = f"({VALID[kind]}) or ({FORM[kind]})" if kind in FORM else VALID[kind]
        texts = texts.withColumn(f"all_{kind}", _matches(PATTERNS[kind], NEEDED[kind], keep, f"'ok', {VALID[kind]}"))
    failed = F.concat(*(F.expr(f"transform(filter(all_{k}, x -> not x.ok), x -> named_struct('s', x.s, 'e', x.e))") for k in FORM))
    texts = texts.withColumn("failed", failed)
    for kind in KINDS[:4]:
        texts = texts.withColumn(kind, F.expr(f"transform(filter(all_{kind}, x -> x.ok), x -> named_struct('s', x.s, 'e', x.e))")).drop(f"all_{kind}")
    return texts


def _words(c: str) -> str:
    return f"filter(split(lower({c}), r'\\s+'), w -> w <> '')"


_NO_WORDS = "cast(array() as array<string>)"


def _last_words(gap: str) -> str:
    """SQL: words of a gap, among them its last two; read off its tail if that holds three."""
    tail = _words(f"right({gap}, {TAIL})")
    return _let("t", tail, f"if(length({gap}) <= {TAIL} or size(t) > 2, t, {_words(gap)})")


def tokens() -> Column:
    """Words with a digit or an at sign: s, e and i, the word in lower case without punctuation
    around it, c, the up to two words before it, and able, whether it can be an identifier."""
    earlier = f"if(i > 1, array(lower(element_at(m, i - 1).h)), {_NO_WORDS})"
    before = f"if(i > 0, concat({earlier}, {_last_words('element_at(m, i).g')}, array(lower(element_at(m, i).h))), {_NO_WORDS})"
    context = _let("own", _last_words("x.g"), _let("all", f"if(size(own) > 1, own, concat({before}, own))", "if(size(all) > 2, slice(all, -2, 2), all)"))
    bare = f"rtrim({_quoted(CLOSING)}, led)"
    inner = _let("led", f"ltrim({_quoted(OPENING)}, x.h)", f"named_struct('skip', length(x.h) - length(led), 'h', {bare}, 'c', {context})")
    able = f"length(y.h) >= {TOKEN_LENGTH} and length(regexp_replace(y.h, '[^0-9]', '')) >= {TOKEN_DIGITS}"
    found = _matches(TOKEN, "text rlike '[0-9@]'", "true", f"'skip', y.skip, 'i', lower(y.h), 'n', length(y.h), 'c', y.c, 'able', {able}", inner)
    return F.transform(found, lambda x: F.struct((x["s"] + x["skip"]).alias("s"), (x["s"] + x["skip"] + x["n"]).alias("e"), x["i"].alias("i"), x["c"].alias("c"), x["able"].alias("able")))


#: SQL: the patterns of a token, from the words before it.
_PATTERNS = "concat(if(size(x.c) >= 2, array(array_join(x.c, ' ')), cast(array() as array<string>)), if(size(x.c) >= 1 and element_at(x.c, -1) rlike '[:=#]$', array(element_at(x.c, -1)), cast(array() as array<string>)))"


def _background(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how many words of the whole corpus follow each of the patterns."""
    # exploding a one-element array keeps the split from being evaluated for every use of it
    words = texts.select(F.explode(F.expr(r"array(filter(split(lower(text), r'\s+'), w -> w <> ''))")).alias("w"))
    pairs = "if(size(w) > 2, zip_with(slice(w, 1, size(w) - 2), slice(w, 2, size(w) - 2), (a, b) -> concat(a, ' ', b)), cast(array() as array<string>))"
    labels = "if(size(w) > 1, filter(slice(w, 1, size(w) - 1), x -> x rlike '[:=#]$'), cast(array() as array<string>))"
    seen = words.select(F.explode(F.expr(f"concat({pairs}, {labels})")).alias("pattern"))
    known = F.broadcast(patterns) if patterns.count() <= SMALL else patterns
    return seen.join(known, "pattern").groupBy("pattern").agg(F.count("*").alias("total"))


def _held(found: DataFrame) -> DataFrame:
    """(uid, s, e, i, p, seed): tokens with a pattern at which a base span starts (seeds), or that
    can be identifiers and meet neither a base span nor a failed one. Tokens and spans of a text
    are met in order of their starts, so a text of many takes no pairs of them."""
    token = f"transform(token, x -> named_struct('t', 1, 's', x.s, 'e', x.e, 'i', x.i, 'p', {_PATTERNS}, 'able', x.able))"
    span = "transform({}, x -> named_struct('t', 0, 's', x.s, 'e', x.e, 'i', '', 'p', cast(array() as array<string>), 'able', {}))"
    all_ = f"concat({token}, {span.format('concat(email, ip, card, phone)', 'true')}, {span.format('failed', 'false')})"
    rows = found.where("size(token) > 0").select("uid", F.explode(F.expr(all_)).alias("x")).select("uid", "x.*")
    order = "over (partition by uid order by s, t)"
    rows = rows.selectExpr(
        "*",
        f"max(if(t = 0, e, null)) {order} as reach",
        f"lead(if(t = 0, s, null)) ignore nulls {order} as next",
        f"last(if(t = 0 and able, s, null)) ignore nulls {order} as base",
    )
    seed = F.expr("coalesce(base = s, false)")
    free = F.expr("able and coalesce(reach <= s, true) and coalesce(next >= e, true)")
    return rows.where("t = 1 and size(p) > 0").withColumn("seed", seed).where(F.col("seed") | free).select("uid", "s", "e", "i", "p", "seed")


def _bootstrap(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(uid, s, e) of tokens that high-scoring patterns bring in."""
    held = stored(_held(found), "pii-held")
    graph = held.select("i", "seed", F.explode("p").alias("pattern")).groupBy("pattern", "i").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    good = graph.where("seed").groupBy("pattern").agg(F.count("*").alias("support")).where(F.col("support") >= SUPPORT).select("pattern")
    good = good.checkpoint()
    # Texts with digits hold all instances. A pattern that other words follow so often there that
    # it could not be confident if all its instances were believed, cannot be with the rest of the
    # corpus either: such patterns need not be looked for in it.
    most = graph.groupBy("pattern").agg(F.sum("n").alias("most"))
    near = _background(texts.where("text rlike '[0-9]'"), good).join(most, "pattern")
    good = near.where(F.col("most") / (F.col("total") + PRIOR) >= CONFIDENT).select("pattern").checkpoint()
    if not good.take(1):
        return held.where("false").select("uid", "s", "e")
    graph = graph.join(_background(texts, good), "pattern").checkpoint()
    scores = graph.groupBy("i").agg(F.max("seed").alias("seed")).withColumn("score", F.col("seed").cast("double")).checkpoint()
    for _ in range(ROUNDS):
        believed = graph.select("pattern", "i", "n", "total").join(scores, "i")
        of = believed.groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / (F.max("total") + PRIOR)).alias("confidence"))
        of = of.withColumn("confidence", F.least(F.col("confidence"), F.lit(0.999)))
        # a pattern of low confidence lends none
        lent = graph.select("pattern", "i").join(of.where(F.col("confidence") >= CONFIDENT), "pattern").groupBy("i").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("lent"))
        scores = scores.join(lent, "i", "left").select("i", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("lent", F.lit(0.0))).alias("score")).checkpoint()
    new = scores.where((~F.col("seed")) & (F.col("score") >= CONFIDENT)).select("i")
    return held.where("not seed").join(new, "i").select("uid", "s", "e")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row's personal data over its whole text: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans (kind:start:end by start, then kind; code points, end exclusive), and
    `every`, the spans as structs (s, k, e), k indexing KINDS.

    Null or empty text: no spans. One row per input row, repeated rows and null ids too. No rows:
    no rows. Columns of docs besides the two and `keep` are not looked at."""
    shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep)
    found = base_matches(rows).withColumn("token", tokens())
    # the uid is written with its row, so it stays the same from here on
    found = stored(found.drop("text").withColumn("uid", F.monotonically_increasing_id()), "pii-found")
    new = _bootstrap(found, rows.select("text"))
    more = new.select("uid", "s", "e").distinct().groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("s", F.lit(4).alias("k"), "e"))).alias("more"))
    out = found.join(more, "uid", "left")
    base = F.array_sort(F.concat(*(F.expr(f"transform({k}, x -> named_struct('s', x.s, 'k', {n}, 'e', x.e))") for n, k in enumerate(KINDS[:4]))))
    out = out.withColumn("base", base)
    out = out.withColumn("every", F.expr("if(more is null, base, array_sort(concat(base, more)))"))
    names = ", ".join(f"'{k}'" for k in KINDS)
    joined = lambda c: F.expr(f"array_join(transform({c}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')")
    return out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("every").alias("spans"), "every", *keep)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of personal data replaced by its kind in angle brackets, such as
    <EMAIL>, and n_chars brought up to date; all rows and columns stay."""
    names = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    columns = docs.columns
    kept = docs.withColumn("__text", F.col("text")).select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(columns)), "__text")
    # spans travel with the row: find() keeps its columns
    found = find(kept.withColumn("__id", F.lit(None).cast("long")), "__id", "__text", tuple(f"__{i}" for i in range(len(columns))))
    at = f"__{columns.index('text')}"
    # spans that reach beyond all before them, with that reach r: what lies between is kept
    reach = _running("transform(every, x -> x.e)", "greatest({0}, {1})")
    spans = f"filter(zip_with(every, {reach}, (x, r) -> named_struct('r', r, 's', x.s, 'k', x.k, 'e', x.e)), x -> x.e > x.r)"
    blocks = f"transform(sequence(0, size(k) - 1, {BLOCK}), i -> slice(k, i + 1, {BLOCK}))"
    piece = f"concat(substring(t, x.r - element_at(b, 1).r + 1, greatest(x.s - x.r, 0)), element_at(array({names}), x.k + 1))"
    cut = f"substring({at}, element_at(b, 1).r + 1, element_at(b, -1).e - element_at(b, 1).r)"
    joined = f"array_join(transform({blocks}, b -> {_let('t', cut, f"array_join(transform(b, x -> {piece}), '')")}), '')"
    clean = F.expr(f"if(size(every) = 0, {at}, {_let('k', spans, f'concat({joined}, substring({at}, element_at(k, -1).e + 1))')})")
    found = found.withColumn(at, clean)
    if "n_chars" in columns:
        found = found.withColumn(f"__{columns.index('n_chars')}", F.length(at).cast("long"))
    return found.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(columns)))
