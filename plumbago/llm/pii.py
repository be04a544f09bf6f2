"""Personal data: base patterns, and terms of the text that reveal them by corpus co-occurrence. DataFrame and SQL functions only.

Base kinds, leftmost and non-overlapping within each; a match that fails its check is dropped and not retried:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``;
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, every part at most 255;
* card ``[0-9]([\\x20-]?[0-9])+`` of 16 to 19 digits that pass Luhn;
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` of 8 to 15 digits.

The expressions run with possessive quantifiers and a look-behind that skips places at which no leftmost match can begin, which changes no match but makes them linear
and keeps them off the stack. No function of Spark gives all offsets of a pattern, so they are summed up from the lengths of the pieces between matches, by running totals that take a
logarithmic number of linear steps.

Information-theoretic sanitisation. Protected entities are the normalised values of base spans. Terms are words (runs of letters), lower-cased, and co-occur with an entity if a document
holds both. Over all documents, n(t, e) counts the occurrences of term t in documents that hold e, n(t) those in the corpus, n(e) the words of documents that hold e, N all words;
p(e) = n(e) / N and IC(e) = -log2 p(e). m(t, e) is n(t, e) with equal texts counted once, as a copy is no evidence. P(e | t) is n(t, e) / n(t), weighed by m occurrences and
smoothed by one more that is distributed like the corpus: P' = (m + p(e)) / (m n(t) / n(t, e) + 1). With PMI(t; e) = log2(P' / p(e)), t discloses e if PMI >= theta IC(e) and the next
occurrence is likelier with e than without, m > (m n(t) / n(t, e) + 1) / 2. No count is asked for: an entity seen once has the terms that keep to its document, but a word seen once
in all is no evidence of either. Every occurrence of a disclosing term in a document that holds its entity becomes a span of kind ``term``, outside base spans. sanitise() puts ``<EMAIL>`` and so on for
base spans and ``<TERM>`` for terms.

Cost. No step is quadratic in the spans or the length of a text: overlaps are found by running maxima, and texts are put together again from blocks (arrays.PIECE).

Corpus counts cover all rows. Words are pre-aggregated per text and term, and only terms with most of their occurrences beside entities are paired with them; entities of one and the same single text are one class. What is small is broadcast only if its count allows it.

Cases. A null text is empty and stays null; empty texts have no spans. Offsets count code points, ends are exclusive. Rows with the same doc_id and text have the same spans; a null doc_id is like any
other. Repeated rows count as often as they occur. An empty table gives an empty result. Very long texts are whole. Other columns pass through sanitise() unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbago.llm.arrays import apart, let, replaced, running
from plumbago.llm.cluster import checkpoint, fresh, read, row_key, small

KINDS = ("email", "ip", "card", "phone")
THETA = 0.9
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a span of the kind must show, cheaply.
_MAY = {"email": "contains(t, '@')", "ip": r"rlike(t, r'[0-9]\.[0-9]')", "card": "rlike(t, r'[0-9](?:[\\x20-]?[0-9]){15}')", "phone": "contains(t, '+')"}
_WORD = r"\p{L}+"
_FOUND = "array<struct<start:int,end:int,value:string>>"
_NONE = f"cast(array() as {_FOUND})"


def located(text: str, pattern: str) -> str:
    """SQL for all matches of a pattern: an array of start, end, value."""
    ends = running("zip_with(f.m, slice(f.g, 1, size(f.m)), (m, g) -> length(m) + length(g))")
    found = f"named_struct('m', regexp_extract_all({text}, r'{pattern}', 0), 'g', split({text}, r'{pattern}', -1))"
    return let("f", found, f"zip_with(f.m, {ends}, (m, e) -> named_struct('start', e - length(m), 'end', e, 'value', m))")


_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + if(pmod(length({_DIGITS}) - i, 2) = 1,
      cast(substring({_DIGITS}, i, 1) as int) * 2 - if(cast(substring({_DIGITS}, i, 1) as int) > 4, 9, 0), cast(substring({_DIGITS}, i, 1) as int))) % 10 = 0"""
_HOLDS = {
    "email": "true",
    "ip": "forall(split(s.value, '[.]'), p -> length(regexp_replace(p, '^0+', '')) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)",
    "card": f"if(length({_DIGITS}) between 16 and 19, {_LUHN}, false)",
    "phone": f"length({_DIGITS}) between 8 and 15",
}


def _spans(text: str, kind: str) -> str:
    return f"if({_MAY[kind].replace('(t,', f'({text},')}, filter({located(text, PATTERNS[kind])}, s -> {_HOLDS[kind]}), {_NONE})"


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """df with the arrays email, ip, card, phone of start, end, value for the (non-null) text column."""
    return df.withColumns({k: F.expr(_spans(text, k)) for k in KINDS})


def _entities() -> str:
    """SQL for the distinct protected entities of a row's base spans."""
    value = {"email": "lower(s.value)", "ip": "s.value"}
    return "array_distinct(concat(" + ", ".join(f"transform({k}, s -> concat('{k}:', {value.get(k, _DIGITS)}))" for k in KINDS) + "))"


def _words(text: str) -> str:
    return f"transform(regexp_extract_all({text}, r'{_WORD}', 0), w -> lower(w))"


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, key, the base spans, entities and, where there are any, the text and its own key; cut from its lineage, as it is read several times."""
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = base_spans(rows, "t")
    some = F.expr(" or ".join(f"size({k}) > 0" for k in KINDS))
    return checkpoint(rows.select("doc_id", "key", *KINDS, F.when(some, F.expr(_entities())).alias("entities"), F.when(some, F.col("t")).alias("t"), F.when(some, row_key(F.col("t"))).alias("same")))


def disclosing(docs: DataFrame, found: DataFrame, theta: float = THETA) -> tuple[DataFrame, DataFrame]:
    """same (a text's key), entity, class; and class, term of all pairs that disclose. Entities that one and the same text alone holds are one class."""
    texts = found.filter("t is not null").groupBy("same").agg(F.count("*").alias("copies"), F.first("t").alias("t"), F.first("entities").alias("entities"))
    texts = checkpoint(texts.withColumn("words", F.expr(_words("t"))).drop("t").withColumn("n_words", F.size("words").cast("long") * F.col("copies")))
    held = texts.select("same", F.explode("entities").alias("entity"))
    known = held.groupBy("entity").agg(F.count("*").alias("n"))
    held = checkpoint(held.join(known, "entity").select("same", "entity", F.when(F.col("n") > 1, F.col("entity")).otherwise(F.hex("same")).alias("class")))
    classes = held.select("same", "class").distinct()
    beside = checkpoint(texts.select("same", "copies", F.explode("words").alias("term")).groupBy("same", "copies", "term").agg(F.count("*").alias("n")))
    counted = docs.select(F.explode(F.expr(_words("cast(text as string)"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    counted = checkpoint(counted)
    total = float(counted.agg(F.sum("n_t")).first()[0] or 0)
    most = beside.groupBy("term").agg(F.sum(F.col("n") * F.col("copies")).alias("m_t")).join(counted, "term").filter("2 * m_t > n_t").select("term", "n_t")
    joint = beside.join(most, "term").join(classes, "same").groupBy("class", "term").agg(F.sum(F.col("n") * F.col("copies")).alias("n_te"), F.sum("n").alias("m"), F.first("n_t").alias("n_t"))
    share = texts.select("same", "n_words").join(classes, "same").groupBy("class").agg((F.sum("n_words") / F.lit(max(total, 1.0))).alias("p"))
    scale = F.col("m") * F.col("n_t") / F.col("n_te") + 1
    pmi = F.log2((F.col("m") + F.col("p")) / scale / F.col("p"))
    return held, joint.filter(2 * F.col("m") > scale).join(share, "class").filter(pmi >= -theta * F.log2("p")).select("class", "term")


def _terms(docs: DataFrame, found: DataFrame, theta: float) -> DataFrame:
    """key and the places of disclosing terms, for rows that have any."""
    held, pairs = disclosing(docs, found, theta)
    said = checkpoint(held.select("same", "class").distinct().join(pairs, "class").select("same", "term").distinct())
    texts = found.filter("t is not null").dropDuplicates(["same"]).join(small(said.select("same").distinct()), "same", "left_semi")
    pieces = texts.select("same", F.posexplode(F.expr(f"zip_with(split(t, r'{_WORD}', -1), regexp_extract_all(t, r'{_WORD}', 0), (g, w) -> named_struct('g', length(g), 'w', w))")).alias("at", "x")).filter("x.w is not null")
    ends = F.sum(F.expr("x.g + length(x.w)")).over(Window.partitionBy("same").orderBy("at")).cast("int")
    places = pieces.select("same", F.lower("x.w").alias("term"), (ends - F.length("x.w")).alias("start"), ends.alias("end"))
    hit = places.join(small(said), ["same", "term"], "left_semi").select("same", (F.col("end") - 1).alias("at"), F.lit(1).alias("word"), "start", "end", "term")
    base = texts.select("same", F.explode(F.expr("concat(" + ", ".join(KINDS) + ")")).alias("b")).select("same", F.col("b.start").alias("at"), F.lit(0).alias("word"), "b.start", "b.end", F.lit(None).cast("string").alias("term"))
    over = F.max(F.when(F.col("word") == 0, F.col("end"))).over(Window.partitionBy("same").orderBy("at", "word").rowsBetween(Window.unboundedPreceding, 0))  # base spans that begin before the word's end
    clear = hit.union(base).withColumn("over", over).filter("word = 1 and coalesce(over, 0) <= start")
    found_in = clear.groupBy("same").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("term").alias("value")))).alias("term"))
    return checkpoint(found.filter("t is not null").select("key", "same").distinct().join(found_in, "same").select("key", "term"))


def personal_data(docs: DataFrame, theta: float = THETA) -> DataFrame:
    """doc_id, key, and the arrays email, ip, card, phone, term of start, end, value: a row for each row of docs."""
    found = _found(docs)
    terms = _terms(docs, found, theta)
    return found.join(small(terms), "key", "left").select("doc_id", "key", *KINDS, F.coalesce("term", F.expr(_NONE)).alias("term"))


def sanitise(docs: DataFrame, theta: float = THETA) -> DataFrame:
    """docs with personal data generalised to its kind and disclosing terms to ``<TERM>``. Spans that overlap are joined and named after the first."""
    key, spans = fresh(docs, "key"), fresh(docs, "spans")
    every = personal_data(docs, theta)
    marked = "concat(" + ", ".join(f"transform({k}, s -> named_struct('start', s.start, 'end', s.end, 'kind', upper('{k}')))" for k in (*KINDS, "term")) + ")"
    found = checkpoint(every.select("key", F.expr(marked).alias("spans")).filter("size(spans) > 0").select("key", F.expr(apart("spans")).alias("spans")).dropDuplicates(["key"]))
    rows = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(small(found.toDF(key, spans)), key, "left")
    return rows.withColumn("text", F.when(F.col(spans).isNotNull(), F.expr(replaced("text", spans, "concat('<', s.kind, '>')"))).otherwise(F.col("text"))).select(*docs.columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda kinds: "array_join(concat(" + ", ".join(f"transform({k}, s -> concat('{k}:', s.start, ':', s.end))" for k in kinds) + "), ',')"
    found = personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.expr(said(KINDS)), 256).alias("base_sha256"), F.expr(said((*KINDS, "term"))).alias("spans"))


_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "word": r"\p{L}+",
}

#: The result by plain expressions and joins: spans, co-occurrence counts over all texts, disclosing terms, their places.
SQL = (
    "with d as (select doc_id, coalesce(text, '') as t from documents), x as (select t, count(*) as copies, row_number() over () as same from d group by t),\n"
    "f as ("
    + " union all ".join(f"select same, '{k}' as kind, {n} as place, regexp_extract_all(t, '{p}') as m, regexp_split_to_array(t, '{p}') as g from x" for n, (k, p) in enumerate(_PLAIN.items()))
    + r"""),
u as (select same, kind, place, unnest(m) as v, unnest(list_slice(g, 1, len(m))) as g, generate_subscripts(m, 1) as i from f where len(m) > 0),
y as (select same, kind, place, v, cast(sum(length(g) + length(v)) over (partition by same, kind order by i) as bigint) as e, regexp_replace(v, '[^0-9]', '', 'g') as n from u),
b as (
  select same, kind, place, v, e - length(v) as s, e, kind || ':' || case kind when 'email' then lower(v) when 'ip' then v else n end as entity from y
  where kind = 'email' or kind = 'phone' and length(n) between 8 and 15
     or kind = 'ip' and len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 or cast('0' || right(p, 3) as int) > 255)) = 0
     or kind = 'card' and length(n) between 16 and 19 and list_sum(list_transform(range(1, length(n) + 1), lambda i: case when (length(n) - i) % 2 = 0 then cast(substr(n, i, 1) as int) else cast(substr(n, i, 1) as int) * 2 - case when cast(substr(n, i, 1) as int) > 4 then 9 else 0 end end)) % 10 = 0
), w as (select same, lower(v) as term, e - length(v) as s, e from y where kind = 'word'),
c as (select same, term, count(*) as n from w group by same, term),
nt as (select term, sum(n * copies) as n_t from c join x using (same) group by term),
nw as (select same, sum(n) * any_value(copies) as n_words from c join x using (same) group by same),
h as (select distinct same, entity from b), many as (select entity, count(*) as n from h group by entity),
k as (select same, entity, case when n > 1 then entity else 'text ' || same end as class from h join many using (entity)),
q as (select distinct same, class from k),
beside as (select c.*, copies from c join x using (same) where same in (select same from h)),
most as (select term, any_value(n_t) as n_t from beside join nt using (term) group by term having 2 * sum(n * copies) > any_value(n_t)),
j as (select class, term, sum(n * copies) as n_te, sum(n) as m, any_value(n_t) as n_t from beside join most using (term) join q using (same) group by class, term),
p as (select class, sum(coalesce(n_words, 0)) / greatest((select sum(n_t) from nt), 1) as p from q left join nw using (same) group by class),
z as (select class, term, m, p, m * n_t / n_te + 1 as scale from j join p using (class)),
said as (select distinct same, term from q join z using (class) where 2 * m > scale and ln((m + p) / scale / p) / ln(2) >= -"""
    + str(THETA)
    + r""" * ln(p) / ln(2)),
o as (select w.same, w.s, w.e from w join said using (same, term) where not exists (select 1 from b where b.same = w.same and b.s < w.e and b.e > w.s)),
l as (select same, kind, place, s, kind || ':' || s || ':' || e as told from b union all select same, 'term', 9, s, 'term:' || s || ':' || e from o),
r as (select same, string_agg(told, ',' order by place, s) as spans, string_agg(told, ',' order by place, s) filter (kind <> 'term') as base, """
    + ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in KINDS)
    + " from l group by same)\nselect doc_id, "
    + ", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in KINDS)
    + ", sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d join x using (t) left join r using (same)"
)
