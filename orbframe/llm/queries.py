"""The registered queries of this package, and their SQL where SQL can say the same."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orbframe.llm import bpe, counts, fmindex, lexical, licenses, lines, near, packing, pieces, quality, resample, search, suffixes

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_bpe_transducer")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_SQL = rf"""
with d as materialized (
  select doc_id, coalesce(text, '') as t, {_WORDS} as w, string_split(coalesce(text, ''), chr(10)) as lines from documents
), windows as materialized (
  select doc_id, i, hash(array_to_string(list_slice(w, i, i + 7), ' ')) as h, array_to_string(list_slice(w, i, i + 7), ' ') as s
  from d, lateral (select unnest(generate_series(1, len(w) - 7)) as i)
), twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, h, s) as n from windows) where n > 1
), repeated as (
  select doc_id, sum(least(8, coalesce(lead_i - i, 8))) as n
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as lead_i from twice) group by doc_id
), line as (
  select doc_id, pos, l, trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g')) as x
  from (select doc_id, unnest(lines) as l, generate_subscripts(lines, 1) as pos from d)
), judged as (
  select doc_id, pos, l, x, length(x) as n, length(x) - length(replace(x, ' ', '')) + 1 as words,
    length(x) - length(regexp_replace(x, '[#*$%&|<>{{}}\\^~_=!»•·]', '', 'g')) as marks,
    len(list_filter(string_split(x, ' '), lambda p: regexp_matches(p, '[#*$%&|<>{{}}\\^~_=!»•·]$'))) as marked,
    len(list_filter(string_split(x, ' ')[2:], lambda p: regexp_matches(p, '^[|>»•·]$'))) as bars
  from line
), bad as (
  select doc_id, pos, l,
    n > 0 and ((bars >= 3 and bars * 4 >= words) or marks * 100 > n * {quality.MOST_MARKS} or (marked * 100 > words * {quality.MOST_MARKED} and words >= 3)
      or (words <= {quality.PHRASE_WORDS} and ({" or ".join(f"contains(lower(x), '{p}')" for p in quality.BOILERPLATE)}))) as fails
  from judged
), left_over as (
  select doc_id, coalesce(sum(length(l)) filter (not fails), 0) + greatest(coalesce(count(*) filter (not fails), 0) - 1, 0) as n,
    count(*) filter (regexp_matches(l, '[^\x20\x09-\x0D]')) - count(distinct l) filter (regexp_matches(l, '[^\x20\x09-\x0D]')) as dup
  from bad group by doc_id
), f as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    left_over.dup::bigint as n_dup_lines, coalesce(repeated.n, 0)::bigint as n_repeat_words, length(t) as n_text, left_over.n as n_left
  from d join left_over using (doc_id) left join repeated using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and (n_text - n_left) * 100 <= n_text * {quality.MOST_LOST} as kept
from f
"""


@query("op2_quality_rules", QUALITY_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdicts for all documents."""
    return quality.digest(table(spark, sf_dir, "documents"))


NEAR_SQL = rf"""
with recursive d as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as materialized (
  select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d
), n as materialized (select doc_id, count(*) as n from s group by doc_id
), e as materialized (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all) p
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 80 * (na.n + nb.n - i)
), r(doc_id, node) as (select doc_id, doc_id from d union select r.doc_id, e.b from r join e on e.a = r.node)
, c as (select doc_id, min(node) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from d join c using (doc_id) left join n using (doc_id)
"""


@query("op10_minhash_hamming", NEAR_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates among all documents."""
    return near.linked(table(spark, sf_dir, "documents"))


SEARCH_SQL = """
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""


@query("op1_norm_sorted_search", SEARCH_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all other vectors for every hundredth."""
    return search.top(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


@query("op4_fuzzy_lines")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all documents that takes part, and the line that stays for it."""
    return lines.groups(table(spark, sf_dir, "documents"))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op8_unigram_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the unigram model."""
    return counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query("op3_suffix_merge")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without 50-byte strings that an earlier one has, as digests."""
    return suffixes.removed(table(spark, sf_dir, "documents")).drop("kept")


REPEATS_SQL = rf"""
with d as materialized (select doc_id, {_WORDS} as w from documents
), s as materialized (select doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') as s from d, lateral (select unnest(generate_series(1, len(w) - 49)) as i)
), f as materialized (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as least from s) where least < doc_id
), gone as materialized (select distinct doc_id, unnest(generate_series(i, i + 49)) as i from f
), word as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d
), kept as (select word.doc_id, string_agg(word, ' ' order by word.i) as t, count(*) as n from word anti join gone on gone.doc_id = word.doc_id and gone.i = word.i group by 1)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""


@query("op7_fm_index", REPEATS_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages of 50 words that an earlier one has, as digests."""
    return fmindex.removed(table(spark, sf_dir, "documents"))


RANKED_SQL = r"""
with t as materialized (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
), q as materialized (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), d as materialized (select doc_id, count(*) as n from t group by 1
), s as (select count(*) as docs_n, sum(n)::bigint as every from d
), p as materialized (select doc_id, term, count(*) as tf from t where term in (select term from q) group by 1, 2
), w as materialized (select term, floor(1000 * ln((2 * any_value(docs_n) + 2) / (2 * count(*) + 1)))::bigint as w from p, s group by 1
), f as materialized (
  select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs_n) // every))) as f from p join d using (doc_id) join w using (term), s
), r as (select item_id, doc_id, sum(f)::bigint as score from q join f using (term) group by 1, 2
), o as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score > 0)
select item_id, rank::int as rank, doc_id, score from o where rank <= 10
"""


@query("op11_term_at_a_time", RANKED_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each item of the benchmark."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


_RUNS = r"""
  select {id}, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]), list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as g
  from (select {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from {table})
"""
RESAMPLED_SQL = rf"""
with a as materialized ({_RUNS.format(id="doc_id", table="documents")}
), b as materialized ({_RUNS.format(id="item_id", table="benchmark")}
), g as materialized (select distinct g from (select g from a union all select g from b)
), x as (select g, hex(encode(g)) as h from g
), c as materialized (
  -- a byte is taken in, then there are eight shifts
  select g, (4294967295 - list_reduce(flatten(list_transform(generate_series(1, length(h), 2), lambda i: [(strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda z, y: case when y >= 0 then xor(z, y) else xor(z >> 1, 3988292384 * (z & 1)) end, 4294967295::bigint)) % 10000 as bucket from x
), n as materialized (select bucket, sum(s)::bigint as s, sum(t)::bigint as t from (
    select bucket, 1 as s, 0 as t from a join c using (g) union all select bucket, 0, 1 from b join c using (g)) group by 1
), whole as (select sum(s)::bigint as s, sum(t)::bigint as t from n
), gain as materialized (select bucket, floor(1000 * ln(((n.t + 1) * (whole.s + 10000)) / ((n.s + 1) * (whole.t + 10000))))::bigint as gain from n, whole
), f as materialized (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from a join c using (g) join gain using (bucket) group by 1
), d as materialized (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || sha256('42:' || doc_id)[:8])::bigint as h,
    len(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) >= 20 as able
  from documents left join f using (doc_id)
), e as materialized (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0)))::bigint as score from d
), r as (select *, row_number() over (partition by able order by score desc, doc_id) as place, count(*) over (partition by able) as n from e)
select doc_id, n_features::bigint as n_features, weight, score, case when able and place <= 5 * n // 100 then place end as rank from r
"""


@query("op12_radix_resampling", RESAMPLED_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of five in a hundred documents, weighted towards the benchmark's texts."""
    return resample.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_merge_rounds")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents under the vocabulary of pieces, as digests."""
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
