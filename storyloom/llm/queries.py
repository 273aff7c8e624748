"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.session import configure

from .common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query(
    "op9_top_k",
    """
    WITH v AS MATERIALIZED (
      SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.r, q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.r <> q.r AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
)
def _top_k(spark, sf_dir):
    from .top_k import top_k

    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


_WORDS = r"string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op1_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, list_filter({_WORDS}, lambda w: w <> '') AS w FROM documents),
    i AS (SELECT item_id, list_filter({_WORDS}, lambda w: w <> '') AS w FROM benchmark),
    phrase AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, a, a + 9), ' ') AS p, least(len(w), 10) AS n
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS a FROM i WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM phrase),
    spot AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS a FROM d),
    hits AS (SELECT spot.doc_id, a, s.n, item_id FROM spot, sizes s, phrase
      WHERE a + s.n - 1 <= len(w) AND phrase.n = s.n AND phrase.p = array_to_string(list_slice(w, a, a + s.n - 1), ' ')),
    covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
      FROM (SELECT doc_id, unnest(generate_series(a, a + n - 1)) AS pos FROM hits) GROUP BY doc_id),
    listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN listed l ON l.doc_id = d.doc_id""",
)
def _decontaminate(spark, sf_dir):
    from .decontaminate import decontaminate

    return decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("text_hash")


# Fixed rules of the registered query: (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op2_url_filter")
def _url_filter(spark, sf_dir):
    from .url_filter import url_filter

    return url_filter(load(spark, sf_dir, "pages"), URL_RULES)


@query("op3_quality")
def _quality(spark, sf_dir):
    from .quality import classify

    rows = classify(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "score", "keep")


@query("op8_jaccard_join")
def _jaccard_join(spark, sf_dir):
    from .jaccard import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents")).drop("text_hash", "class_key")


# Target shares of the registered query; what is not listed divides the rest.
MIX = {"source": {"src1": 0.1, "src2": 0.1}, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "topic": {"prose": 0.7}}


@query("op6_mix_sources")
def _mix_sources(spark, sf_dir):
    from .mixing import mix_sources

    rows = mix_sources(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), **MIX)
    return rows.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"))


@query("op7_personal_data")
def _personal_data(spark, sf_dir):
    from .pii import KINDS, listed, personal_data

    rows = personal_data(load(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(KINDS), 256).alias("base_sha256"),
        listed((*KINDS, "term")).alias("spans"), F.size("term").cast("long").alias("n_term"),
    )


@query(
    "op5_sentence_spans",
    r"""
    WITH cut_ AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n][.!?]*|[^.!?\n]+')) AS s,
      generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n][.!?]*|[^.!?\n]+'), 1) AS i FROM documents),
    clause AS (SELECT doc_id, i, CASE WHEN len(list_filter(string_split_regex(s, '[ \t-\r]+'), lambda w: w <> '')) > 12
      THEN regexp_extract_all(s, '[^,;:]*[,;:]|[^,;:]+') ELSE [s] END AS parts FROM cut_),
    part AS (SELECT doc_id, i, unnest(parts) AS raw, generate_subscripts(parts, 1) AS j FROM clause),
    spot AS (SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS pos, list_filter(string_split_regex(lower(raw), '[ \t-\r]+'), lambda w: w <> '') AS w FROM part),
    placed AS (SELECT doc_id, pos, array_to_string(w, ' ') AS s, row_number() OVER d AS r, sum(len(w)) OVER d AS upto, len(w) AS n FROM spot WHERE len(w) > 0
      WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
    whole AS (SELECT doc_id, list(s ORDER BY r) AS s FROM placed GROUP BY doc_id),
    run AS (SELECT a.doc_id, a.r, any_value(a.pos) AS pos, min(e.r) AS stop, min(e.pos) AS last FROM placed a JOIN placed e
      ON e.doc_id = a.doc_id AND e.r BETWEEN a.r + 1 AND a.r + 19 AND e.upto - a.upto + a.n >= 20 GROUP BY a.doc_id, a.r),
    runs AS (SELECT doc_id, pos, last, array_to_string(list_slice(s, r, stop), chr(10)) AS s FROM run JOIN whole USING (doc_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS k FROM runs),
    gone AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, last)) AS pos FROM ranked WHERE k > 1)
    SELECT d.doc_id, count(p.pos) AS n_sentences, count(g.pos) FILTER (WHERE p.pos IS NOT NULL) AS n_removed,
      coalesce(string_agg(raw, '' ORDER BY t.pos) FILTER (WHERE g.pos IS NULL), '') AS text
    FROM documents d LEFT JOIN spot t ON t.doc_id = d.doc_id LEFT JOIN placed p ON p.doc_id = t.doc_id AND p.pos = t.pos
      LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.pos = t.pos
    GROUP BY d.doc_id""",
)
def _sentence_spans(spark, sf_dir):
    from .sentence_spans import remove_repeats

    rows = remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_sentences", "n_removed", F.coalesce("text", F.lit("")).alias("text"))


@query("op4_brown_score")
def _brown_score(spark, sf_dir):
    from .brown import score_texts

    return score_texts(load(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_suffix_dedup")
def _suffix_dedup(spark, sf_dir):
    from .suffixes import remove_repeats

    rows = remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op11_lexical_search",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    size AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
    tf AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, term, n),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, size),
    scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
      FROM i JOIN tf USING (term) JOIN weight USING (term), size GROUP BY item_id, doc_id),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
)
def _lexical_search(spark, sf_dir):
    from .lexical import search

    return search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), k=10)


def looped(docs):
    """The contract's texts: in a tenth of the documents a stretch of words is repeated to the end."""
    w = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.size(w).cast("long").alias("n"), h.alias("h"), F.floor(h / 10).alias("g"))
    rows = rows.select("doc_id", "text", "n", "h", "g", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a"))
    rows = rows.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    n, a, p = (F.col(c).cast("int") for c in ("n", "a", "p"))
    tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), text).otherwise(F.col("text")).alias("text"))


# crc32 of the decimal doc_id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""


@query(
    "op12_periodic_runs",
    f"""
    WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w, CAST({_CRC} AS BIGINT) AS h FROM documents),
    s AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
    l AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(generate_series(0, n - 1), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM s),
    spot AS (SELECT doc_id, n, unnest(w) AS word, unnest(generate_series(0, n - 1)) AS i FROM l WHERE n > 0),
    pair AS (SELECT x.doc_id, x.i, x.i - y.i AS lag FROM spot x JOIN spot y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i AND (x.i - y.i) * 4 <= x.n),
    island AS (SELECT doc_id, lag, count(*) AS m, max(i) AS stop FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS k FROM pair) GROUP BY doc_id, lag, k),
    long_ AS (SELECT doc_id, stop - m - lag + 1 AS start, m + lag AS length, lag AS period FROM island WHERE m + lag >= greatest(6, 4 * lag)),
    run AS (SELECT * FROM long_ r WHERE NOT EXISTS (SELECT 1 FROM long_ q WHERE q.doc_id = r.doc_id AND q.period < r.period AND q.start <= r.start AND q.start + q.length >= r.start + r.length)),
    listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
      first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) AS best FROM run GROUP BY doc_id),
    lost AS (SELECT DISTINCT doc_id, unnest(generate_series(start + period, start + length - 1)) AS i FROM run),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM spot ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
      sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
)
def _periodic_runs(spark, sf_dir):
    from .periodic import periodic_runs

    rows = periodic_runs(looped(load(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, period = -F.col("r.start"), -F.col("r.period")
    return rows.select(
        "doc_id", "n_runs", start.alias("start"), F.col("r.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("r.length") / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


_ESCAPED = r"""regexp_replace({}, '([\[<])(\\*)(/?INST\]|ROLE\]|/?TEXT\]|/?s>)', '\1\\\2\3', 'g')"""


@query(
    "op13_chat_format",
    f"""
    WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(length({_ESCAPED.format("text")}) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length({_ESCAPED.format("role")}) END) AS BIGINT) AS formatted_chars
    FROM rows GROUP BY conv_id""",
)
def _chat_format(spark, sf_dir):
    from .chat import as_events, digests, fold, render

    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    given = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], rows.schema)
    return digests(render(fold(as_events(rows.unionByName(given)))))
