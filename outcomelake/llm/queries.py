"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import digests, format_conversations
from .cross_polytope import near_vectors
from .license_templates import license_scan
from .line_dedup import without_common_lines
from .minhash import near_duplicates
from .mixing import mix
from .packing import pack
from .periodic_runs import periodic_runs, with_planted_periods
from .rule_trees import quality_rules
from ..sources.storage import new_path
from .subword import quality_scores
from .vector_codes import digest_of, vector_codes
from .warc import read_archives, write_archives
from .weak_supervision import toxicity_scores


#: Target parts of the tokens by language, for mixing.
MIXTURE = {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` as WARC archives in the shared folder and read the records back."""
    folder = new_path(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of ``embeddings`` whose cosine is at least 0.9."""
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all ``documents``, fitted on labels outside the fold crc32 mod 5 = 0."""
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all ``documents`` by subword embeddings fitted on labels outside the fold crc32 mod 3 = 1."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the trees' verdict for all ``documents``."""
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack the tokens of all ``documents`` into sequences of at most 1024."""
    return pack(_table(spark, sf_dir, "documents"), capacity=1024)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all ``documents``."""
    return license_scan(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates at which ``documents`` mix to target parts of their languages."""
    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), weights=MIXTURE)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, read back from the formatted texts, of all ``conversations`` and one that quotes control strings."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoted = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", quoted), (-7, 1, "assistant", quoted)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(turns.unionByName(extra)))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ``documents`` whose 3-word shingle sets have a Jaccard similarity of at least 0.85."""
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 12 words in all ``documents``, a tenth of them made periodic, and digests of what remains."""
    found = periodic_runs(_table(spark, sf_dir, "documents"), least_length=12, rewrite=with_planted_periods)
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    every = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("one", first)
    longest = {"start": -F.col("one.start"), "length": F.col("one.length"), "period": -F.col("one.period"), "exponent_milli": F.expr("1000 * one.length div -one.period")}
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *(c.alias(n) for n, c in longest.items()), F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that five ``documents`` or more share, dropped but for their last holder."""
    kept = without_common_lines(_table(spark, sf_dir, "documents"), least_documents=5, least_chars=40)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``: 16 parts, 64 entries each, two rounds."""
    coded, codebooks = vector_codes(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest_of(codebooks)).alias("codebooks_sha256"))


#: What reaches a document or vector through links, and the columns that follow from it.
_REACHED = """reach(id, other) AS (SELECT id, id FROM ids UNION SELECT r.id, l.b FROM reach r JOIN l ON l.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)"""

_SQL = {
    "op1_warc": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages), d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS response FROM d WHERE payload_bytes >= 1000 GROUP BY 1), r AS (SELECT d.*, CASE WHEN page_id <> response THEN response END AS refers_to FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND payload_bytes >= 1000)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r""",
    "op2_embedding_near_dedup": f"""WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings), v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS MATERIALIZED (SELECT id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
l AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id <> y.id WHERE CASE WHEN len(x.e) = len(y.e) THEN list_cosine_similarity(x.e, y.e) >= 0.9 ELSE false END),
{_REACHED}, n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT c.id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.id = component_id AS kept FROM c LEFT JOIN n ON a = c.id""",
    "op9_chat_formatting": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, length(CASE role WHEN 'user' THEN '[INST]  [/INST]' WHEN 'assistant' THEN '<s></s>' WHEN 'system' THEN '<<SYS>>__<</SYS>>_' ELSE '<<ROLE ' || role || '>>__<</ROLE>>_' END)
  + list_sum(list_transform(['\', '<s>', '</s>', '<<SYS>>', '<</SYS>>', '<<ROLE', '<</ROLE', '[INST]', '[/INST]', '>>' || chr(10)], lambda k: (length(text) - length(replace(text, k, ''))) // length(k))) AS added FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(text) + added)::BIGINT AS formatted_chars FROM m GROUP BY 1""",
    "op10_minhash_near_dedup": rf"""WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents),
t AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM t),
n AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.id <> y.id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * common >= 85 * (p.n + q.n - common)), {_REACHED}
SELECT c.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, c.id = component_id AS kept FROM c LEFT JOIN n USING (id)""",
}

_SQL["op12_line_dedup"] = """WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, row_number() OVER () AS r FROM documents), l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM t),
k AS MATERIALIZED (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5), d AS (SELECT k.*, c.key IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY r, doc_id"""


def _rounds_sql(rounds: int) -> str:
    """Assignments a1 .. and the codebooks after each, as common table expressions over the parts p and the first codebooks e0."""
    out = ""
    for i in range(rounds + 1):
        out += f""", a{i} AS MATERIALIZED (SELECT vec_id, label, p.part, any_value(p.v) AS v, min(64 * d + entry) AS best FROM (SELECT p.*, entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - e.v[i]) * (p.v[i] - e.v[i])))::BIGINT AS d FROM p JOIN e{i} e ON p.part = e.part) p GROUP BY ALL)"""
        if i < rounds:
            out += f""", m{i} AS (SELECT part, best % 64 AS entry, place, floor(sum(x) / count(*))::BIGINT AS x FROM (SELECT part, best, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY ALL),
e{i + 1} AS MATERIALIZED (SELECT e.part, e.entry, coalesce(n.v, e.v) AS v FROM e{i} e LEFT JOIN (SELECT part, entry, list(x ORDER BY place) AS v FROM m{i} GROUP BY ALL) n ON n.part = e.part AND n.entry = e.entry)"""
    return out


_SQL["op13_vector_codes"] = f"""WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, q[part * (len(q) // 16) + 1 : (part + 1) * (len(q) // 16)] AS v FROM k, range(16) r(part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT DISTINCT vec_id FROM k) ORDER BY vec_id LIMIT 64), e0 AS MATERIALIZED (SELECT part, entry, v FROM p JOIN f USING (vec_id)){_rounds_sql(2)},
c AS (SELECT vec_id, label, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_embedding_near_dedup, op3_toxicity, op4_quality_classifier, op5_quality_rules, op6_best_fit_packing, op7_license_scans, op8_mixing, op9_chat_formatting, op10_minhash_near_dedup, op11_periodic_runs, op12_line_dedup, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    """SQL for those queries that SQL can express in reasonable time."""
    return dict(_SQL)
