"""Information-theoretic sanitisation of personal data.

Base spans are found by pattern (e-mail and IP addresses, card and phone numbers). Each distinct value is a protected
entity. Words may give it away: over the whole corpus the documents with the entity, with the word, and with both,
however far apart, are counted, and the pointwise mutual information of word and entity is compared with the
information content of the entity. The ratio is 1 where the word reveals the entity entirely. From ``REMOVE`` on the
word is removed, from ``GENERALISE`` on it is replaced by its class, wherever it stands in a document with the entity;
both count from ``SUPPORT`` different texts on only, as one text is no evidence of a habit. Counts are by document; words
are made distinct per document, and words too frequent to reveal an entity are left out before they meet it.

Positions count code points, ends are exclusive. Null text counts as empty: no spans, and sanitised it stays null.
Repeated rows each count as a document, but never as support. Overlapping spans are replaced together. ``find`` keeps
the columns it is told to carry, but for those that bear the name of a kind; ``sanitise`` keeps all columns and changes
none but the text. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebook.session import cut

#: Evidence and thresholds.
SUPPORT, GENERALISE, REMOVE = 2, 0.75, 0.9
#: Fixed patterns. They find what the plain ones find, but start only where a plain match can start and never give
#: characters back, so that long runs take linear time.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term", "word"]
WORD = r"\p{L}[\p{L}\p{M}]{2,}"
SPAN = "struct<start:int,end:int,value:string>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def places(text: str, matches: str, pattern: str) -> Column:
    """Start, end and value of each of the ``matches`` (a column) of ``pattern`` in ``text``, from the gaps between."""
    return F.expr(f"""
        case when size({matches}) > 0 then aggregate(
            zip_with(slice(split({text}, {_quoted(pattern)}, -1), 1, size({matches})), {matches}, (g, v) -> struct(length(g) as gap, v as value)),
            named_struct('at', 0, 'spans', cast(array() as array<{SPAN}>)),
            (a, m) -> named_struct('at', a.at + m.gap + length(m.value), 'spans', concat(a.spans, array(named_struct(
                'start', a.at + m.gap, 'end', a.at + m.gap + length(m.value), 'value', m.value)))),
            a -> a.spans)
        else cast(array() as array<{SPAN}>) end""")


def _digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits):
    def add(total, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _part_fits(part):
    short = F.ltrim(part, F.lit("0"))
    return (F.length(short) <= 3) & (F.concat(F.lit("0"), short).try_cast("int") <= 255)


VALID = {
    "email": None,
    "ip": lambda s: F.forall(F.split(s.value, "\\."), _part_fits),
    "card": lambda s: _luhn(_digits(s.value)),
    "phone": lambda s: F.length(_digits(s.value)).between(8, 15),
}


def base_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with one array of spans per kind, in columns named by kind."""
    out = df.withColumn("__text", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    for kind, pattern in PATTERNS.items():
        out = out.withColumn(f"__{kind}", F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))
    for kind, pattern in PATTERNS.items():
        spans = places("__text", f"__{kind}", pattern)
        out = out.withColumn(kind, spans if VALID[kind] is None else F.filter(spans, VALID[kind]))
    return out.drop(*[f"__{k}" for k in PATTERNS])


def _words(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit(WORD), F.lit(0)))


def _spans_where(test: str) -> Column:
    """Number, start, end and value of those words ``m`` of ``__text`` for which ``test`` holds, words being read once."""
    return F.expr(f"""
        case when size(__m) > 0 then aggregate(
            zip_with(slice(split(__text, {_quoted(WORD)}, -1), 1, size(__m)), __m, (g, v) -> struct(length(g) as gap, v as value)),
            named_struct('n', 0, 'at', 0, 'spans', cast(array() as array<struct<n:int,start:int,end:int,value:string>>)),
            (a, m) -> named_struct('n', a.n + 1, 'at', a.at + m.gap + length(m.value), 'spans', transform(
                array(named_struct('n', a.n, 'start', a.at + m.gap, 'end', a.at + m.gap + length(m.value), 'value', m.value)),
                w -> case when {test} then concat(a.spans, array(w)) else a.spans end)[0]),
            a -> a.spans)
        else cast(array() as array<struct<n:int,start:int,end:int,value:string>>) end""")


# Only values with letters can share letters with a word.
WITH_LETTERS = "filter(concat(" + ", ".join(PATTERNS) + "), s -> s.value rlike '\\\\p{L}')"
IN_VALUE = "exists(__taken, x -> x.start < w.end and w.start < x.end)"


def find(df: DataFrame, text_col: str = "text", carry: tuple = (), name: str = "personal") -> DataFrame:
    """``carry`` columns of ``df`` with the base spans by kind and ``term`` / ``word`` spans: words to remove / to generalise."""
    plain = base_spans(df, text_col).withColumn("__row", F.monotonically_increasing_id())
    entities = F.expr("array_distinct(concat(" + ", ".join(f"transform({k}, s -> xxhash64('{k}', s.value))" for k in PATTERNS) + "))")
    rows = plain.withColumn("__entities", entities).select(
        *[F.col(f"`{c}`") for c in carry if c not in KINDS], "__row", F.xxhash64("__text").alias("__same"), *PATTERNS, "__entities",
        F.when(F.size("__entities") > 0, F.col("__text")).alias("__text"))
    rows = cut(rows, name)
    pairs, risky = _disclosing(df, text_col, rows)
    found = (pairs.join(risky, ["entity", "term"]).groupBy("__row", "term").agg(F.max("remove").alias("remove"))
             .groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("term", "remove"))).alias("__terms")))
    return with_words(rows, found)


def with_words(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every occurrence outside the values is marked. Rows without any base span have no words to hide, so they pass by the join."""
    some = rows.where(F.size("__entities") > 0).join(found, "__row", "left").withColumn(
        "__m", F.when(F.col("__terms").isNotNull(), F.regexp_extract_all("__text", F.lit(WORD), F.lit(0))))
    some = some.withColumn("__taken", F.expr(WITH_LETTERS)).withColumn(
        "__found", _spans_where(f"map_contains_key(__terms, lower(w.value)) and not {IN_VALUE}")).withColumn(
        "__found", F.expr("transform(__found, w -> struct(w.start as start, w.end as end, __terms[lower(w.value)] as remove))"))
    none = rows.where(F.size("__entities") == 0).withColumn("__found", F.expr("cast(null as array<struct<start:int,end:int,remove:boolean>>)"))
    out = some.drop("__terms", "__m", "__taken").unionByName(none)
    for kind, test in (("term", "x.remove"), ("word", "not x.remove")):
        out = out.withColumn(kind, F.expr(f"coalesce(transform(filter(__found, x -> {test}), x -> struct(x.start, x.end)), array())"))
    return out.drop("__row", "__same", "__entities", "__text", "__found")


def _disclosing(df: DataFrame, text_col: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``pairs`` of entity and term by document that may count, and the ``entity``, ``term`` and ``remove`` of those
    terms that reveal an entity beyond the lower threshold.

    Entities without support go first. As a term is never in more documents with the entity than the entity has, the
    ratio can reach the threshold only where n_term <= total * (n_entity / total) ** GENERALISE; other terms are no pairs.
    """
    total = rows.count()
    held = rows.where(F.size("__entities") > 0)
    each = held.select("__row", "__same", F.explode("__entities").alias("entity"))
    n_entity = (each.groupBy("entity", "__same").agg(F.count("entity").alias("n"))
                .groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("n").alias("texts")).where(f"texts >= {SUPPORT}"))
    n_entity = cut(n_entity.withColumn("most", F.floor(
        1e-6 + 1.000001 * total * F.pow(F.col("n_entity") / F.lit(float(max(1, total))), F.lit(GENERALISE)))), "entities")
    most = n_entity.agg(F.max("most")).first()[0] or 0
    backed = each.join(n_entity, "entity").groupBy("__row").agg(F.collect_list(F.struct("entity", "n_entity", "most")).alias("backed"))
    # A term counts where it stands outside the values: of its occurrences those inside are left out.
    words = (held.select("__row", "__same", "__text", F.expr(WITH_LETTERS).alias("__taken")).join(backed, "__row")
             .withColumn("__m", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
             .withColumn("__in", F.transform(_spans_where(IN_VALUE), lambda w: w.n)))
    free = F.expr("array_distinct(transform(case when size(__in) = 0 then __m else filter(__m, (v, i) -> not array_contains(__in, i)) end, v -> lower(v)))")
    words = words.select("__row", "__same", "backed", F.explode(free).alias("term"))
    n_term = (df.select(F.explode(_words(text_col)).alias("term")).groupBy("term").agg(F.count("term").alias("n_term"))
              .where(F.col("n_term").between(SUPPORT, most)))
    pairs = (words.join(n_term, "term").select("__row", "__same", "term", "n_term", F.explode("backed").alias("b"))
             .where("n_term <= b.most").select("__row", "__same", "term", "n_term", "b.entity", "b.n_entity"))
    pairs = cut(pairs, "pairs")
    joint = (pairs.groupBy("entity", "term", "n_entity", "n_term", "__same").agg(F.count("term").alias("n"))
             .groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("n").alias("n_both"), F.count("n").alias("texts"))
             .where(f"texts >= {SUPPORT}"))
    pmi = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    content = F.log2(F.lit(float(total)) / F.col("n_entity"))
    ratio = F.when(content > 0, pmi / content).otherwise(0.0)
    risky = joint.select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= GENERALISE).select(
        "entity", "term", (F.col("ratio") >= REMOVE).alias("remove"))
    return pairs, risky


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans as text."""
    def named(kind):
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s.start, s.end))

    def listed(kinds):
        return F.array_join(F.flatten(F.array(*map(named, kinds))), ",")

    return found.select(
        F.col(f"`{id_col}`").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(listed(list(PATTERNS)), 256).alias("base_sha256"), listed(KINDS).alias("spans"))


def sanitise(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with base spans and disclosing words replaced: <EMAIL>, <IP>, <CARD>, <PHONE>, <REMOVED>; <WORD> or <Name>.

    A generalised word keeps only whether it begins with a capital.
    """
    # Names of its own for all columns, as those of ``df`` may be those of the spans.
    names = {c: f"__column{i}" for i, c in enumerate(df.columns)}
    columns, text_col = df.columns, names[text_col]
    df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = find(df, text_col, tuple(df.columns), "sanitised")
    marks = F.expr("array_sort(concat(" + ", ".join(
        f"transform({k}, s -> named_struct('start', s.start, 'end', s.end, 'mark', " + (
            f"case when substring(`{text_col}`, s.start + 1, 1) rlike '^\\\\p{{Lu}}' then '<Name>' else '<WORD>' end" if k == "word" else
            "'<REMOVED>'" if k == "term" else f"'<{k.upper()}>'") + "))" for k in KINDS) + "))")
    done = found.withColumn("__marks", marks)
    done = done.withColumn(text_col, F.expr(f"""
        case when size(__marks) = 0 then `{text_col}` else aggregate(__marks,
            named_struct('at', 0, 'out', cast(array() as array<string>)),
            (a, m) -> case when m.start >= a.at
                then named_struct('at', m.end, 'out', concat(a.out, array(substring(`{text_col}`, a.at + 1, m.start - a.at), m.mark)))
                else named_struct('at', greatest(a.at, m.end), 'out', a.out) end,
            a -> concat(concat_ws('', a.out), substring(`{text_col}`, a.at + 1, length(`{text_col}`)))) end"""))
    return done.select(*[F.col(names[c]).alias(c) for c in columns])
