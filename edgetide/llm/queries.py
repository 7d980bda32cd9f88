"""Registered queries of this subpackage and, where SQL can express them, the DuckDB statements to compare them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.llm import bin_packing, bpe_codec, cholesky_whitening, compression_toxicity, document_fp_tree, entropy_mix, feistel, license_join, prob_minhash, quality_rules, template_leaks, tool_calls, warc
from edgetide.llm.common import table

WORD_SQL = r"'[^\x20\x09-\x0D]+'"


def q_op1_vector_bin_packing(spark: SparkSession, d: str) -> DataFrame:
    return bin_packing.shards_of(table(spark, d, "documents")).select(
        "doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens")


def q_op2_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, d, "documents").select("doc_id", "text"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(quality_rules.mask("base")).cast("long")) != 0).alias("base_failed"),
        (quality_rules.rejected(quality_rules.POLICY) == 0).alias("kept"), "failed")


def q_op3_entropy_balancing(spark: SparkSession, d: str) -> DataFrame:
    return entropy_mix.mix(table(spark, d, "documents").select("doc_id", "text", "source")).select(
        "doc_id", *(f"_mix.{c}" for c in ("size", "source_size", "target", "taken", "rate", "copies")))


def q_op4_template_leaks(spark: SparkSession, d: str) -> DataFrame:
    """A row for every document and benchmark item that it leaks."""
    return template_leaks.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select(
        "doc_id", "item_id", "coverage", "slots", "changed")


def q_op6_prob_minhash(spark: SparkSession, d: str) -> DataFrame:
    return prob_minhash.near_duplicates(table(spark, d, "documents"))


def q_op7_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.archive_and_read(spark, table(spark, d, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def q_op8_compression_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    scored = compression_toxicity.score(docs, compression_toxicity.fit(docs, table(spark, d, "labels")))
    return scored.select("doc_id", compression_toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


REPLY_SCHEMA = {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {
    "text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}


def q_op5_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Whole conversations, user turns as calls of a reply tool: a row for every turn, whatever its role."""
    return tool_calls.link(tool_calls.exchange_events(table(spark, d, "conversations"), whole=True), {"reply": REPLY_SCHEMA})


# In production the key comes from a secret store; the queries need one that reruns agree on.
PSEUDONYM_KEY = "key of the registered queries"


def q_op9_feistel_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    """The whole texts with their pseudonyms, and what was replaced by kind."""
    return feistel.pseudonymise(table(spark, d, "documents").select("doc_id", "text"), PSEUDONYM_KEY).select(
        "doc_id", "text", F.size("found").cast("long").alias("n_replaced"),
        F.array_join(F.array_sort(F.array_distinct("found.kind")), ",").alias("kinds"))


def q_op10_license_join(spark: SparkSession, d: str) -> DataFrame:
    return license_join.scan(table(spark, d, "documents"))


def q_op11_bpe_codec(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers  # only this query needs the package

    merges = bpe_codec.Merges.read(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe_codec.decode(bpe_codec.encode(table(spark, d, "documents"), merges), merges).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def q_op12_cholesky_whitening(spark: SparkSession, d: str) -> DataFrame:
    return cholesky_whitening.whitened_components(table(spark, d, "embeddings"))


def q_op13_document_fp_tree(spark: SparkSession, d: str) -> DataFrame:
    return document_fp_tree.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


QUALITY = rf"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, {WORD_SQL}) as w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
windows as (select r, i, array_to_string(w[i:i + 4], ' ') as win
  from (select r, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
starts as (select r, i from (select r, i, count(*) over (partition by r, win) as n from windows) where n > 1),
covered as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from starts) group by r),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
    len(l) as n_lines, len(list_distinct(w)) as n_unique
  from w left join covered c using (r)),
f as (select *, n_words < 10 as b0, 100 * n_repeat_words > 20 * n_words as b1, 10 * n_symbols > n_words as b2,
  100 * n_dup_lines > 30 * n_lines as b3, word_chars < 2 * n_words as b4, word_chars > 20 * n_words as b5,
  n_words >= 50 and 100 * n_unique < 10 * n_words as b6 from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 or b1 as base_failed,
  not (b0 or b1 or b2 or b3 or b4 or b5 or b6) as kept,
  (b0::int + 2 * b1::int + 4 * b2::int + 8 * b3::int + 16 * b4::int + 32 * b5::int + 64 * b6::int)::bigint as failed from f"""


# SHA-1 as 160 bits, five of them to a character
PAYLOADS = """with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, strlen(html)::bigint as payload_bytes, cast(unhex(sha1(html))::bit as varchar) as bits,
  min(page_id) over (partition by html) as first_id from p)
select page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0b' || substr(bits, 1 + 5 * k, 5))::int), 1) for k in range(32)], '') as payload_digest,
  case when page_id is null or page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to from h"""

LICENSE_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LICENSES = f"""with d as (select row_number() over () as r, doc_id,
    translate(coalesce(text, ''), '{license_join.UPPER}', '{license_join.LOWER}') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, {LICENSE_WORD}) as w from d),
phrases(p, label) as (values {", ".join(f"({p.split()}, '{label}')" for p, label in license_join.PHRASES.items())}),
base as (select r, count(*) as n, min(i) - 1 as first_word, max(i) - 1 as last_word, list(distinct label) as labels
  from (select r, w, unnest(range(1, len(w) + 1)) as i from w) join phrases on w[i:i + len(p) - 1] = p group by r),
templates as (select label, list_distinct(w) as tw, ceil(len(w) / {license_join.CONTAINMENT} - 1e-9)::bigint as span
  from (select label, regexp_extract_all(translate(t, '{license_join.UPPER}', '{license_join.LOWER}'), {LICENSE_WORD}) as w
    from (values {", ".join(f"('{label}', '{t}')" for label, t in license_join.TEMPLATES)}) as x(label, t))),
-- a block may as well begin at a word of the template
spots as (select r, w, label, tw, span, unnest(range(1, len(w) + 1)) as i from w
  join templates on len(list_intersect(w, tw)) >= ceil({license_join.CONTAINMENT} * len(tw) - 1e-9)),
blocks as (select r, label, len(tw) as size, len(list_intersect(w[i:i + span - 1], tw)) as n
  from spots where list_contains(tw, w[i])),
found as (select r, list(distinct label) as labels, max(n / size) as score from blocks
  where n >= ceil({license_join.CONTAINMENT} * size - 1e-9) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, first_word::bigint as first_word,
  last_word::bigint as last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, f.labels))), ','), '') as labels,
  case when b.n > 0 then 1.0::double else coalesce(score, 0)::double end as score
from w left join base b using (r) left join found f using (r)"""


def _terms(text: str) -> str:
    folded = f"translate(coalesce({text}, ''), '{document_fp_tree.UPPER}', '{document_fp_tree.LOWER}')"
    return f"regexp_extract_all({folded}, '{document_fp_tree.TERM}')"


RANKED = f"""with d as (select row_number() over () as r, doc_id, {_terms("text")} as t from documents),
items as (select row_number() over () as i, item_id, list_distinct({_terms("text")}) as t from benchmark),
stats as (select count(*) filter (len(t) > 0)::bigint as docs, sum(len(t))::bigint as words from d),
tf as (select r, term, count(*)::bigint as tf from (select r, unnest(t) as term from d)
  where term in (select unnest(t) from items) group by r, term),
weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from tf, stats group by term),
norms as (select r, doc_id, 100 - 50 + ((50 * len(t)::bigint * docs) // words) as m from d, stats where len(t) > 0),
scores as (select i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
  from (select i, item_id, unnest(t) as term from items) join weights using (term) join tf using (term) join norms using (r)
  group by i, item_id, r, doc_id)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by i order by score desc, doc_id) as rank from scores where score > 0)
where rank <= {document_fp_tree.TOP}"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": QUALITY, "op7_warc": PAYLOADS, "op10_license_join": LICENSES,
            "op13_document_fp_tree": RANKED}
