"""Registered queries of the corpus operators, and their SQL where there is any."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from batchloom.llm import (
    alignment, conversations, decontaminate, html_text, line_dedup, mixing, near_dups, neighbours, packing, quality, sharding, token_ids,
    tokens, warc,
)
from batchloom.llm.common import table
from batchloom.session import staging_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: whole numbers; values that are not named have weight 1
MIX_WEIGHTS = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 2},
}


def mix_levels() -> dict[str, Column]:
    """Domain (the number of the source modulo four), language, source."""
    number = F.regexp_extract("source", r"(\d+)", 1)
    domain = F.concat(F.lit("d"), F.pmod(F.when(number == "", F.lit("0")).otherwise(number).cast("long"), F.lit(4)).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


@register("op1_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    s AS (SELECT *, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
    SELECT page_id, strlen(html) AS payload_bytes,
        list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (((('0x' || substr(hex, ((i // 4) * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::INTEGER, 1)),
            'string_agg', '') AS payload_digest,
        CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM s""")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{staging_dir(spark)}/warc-{uuid.uuid4().hex}"
    found = warc.read(warc.write(warc.with_revisits(pages), folder), folder)
    kind = pages.schema["page_id"].dataType
    return found.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


_SHARE = """
    SELECT *, CASE WHEN whole THEN held
        ELSE (greatest(budget - coalesce(held_full, 0), 0)::HUGEINT * w) // w_rest END AS given
    FROM (
        SELECT *, sum(held) FILTER (whole) OVER (PARTITION BY {family}) AS held_full,
            sum(w) FILTER (NOT whole) OVER (PARTITION BY {family}) AS w_rest
        FROM (
            SELECT *, held::HUGEINT * w_left <= w::HUGEINT * (budget - held_before) AS whole
            FROM (
                SELECT *, coalesce(sum(held) OVER (PARTITION BY {family} ORDER BY held / w, {level}
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held_before,
                    sum(w) OVER (PARTITION BY {family} ORDER BY held / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
                FROM {nodes})))"""


def _mix_sql() -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items())
        return f"(CASE {level} {cases} ELSE 1 END)::BIGINT AS w"

    return f"""
    WITH d AS (
        SELECT doc_id, lang, source, len(regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r ]+'))::BIGINT AS tokens,
            'd' || (coalesce(nullif(regexp_extract(source, '([0-9]+)', 1), ''), '0')::BIGINT % 4) AS domain FROM documents),
    leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply, 4 * sum(tokens)::BIGINT AS held FROM d WHERE tokens > 0 GROUP BY ALL),
    n1 AS (SELECT domain, sum(held)::BIGINT AS held, {weight("domain")}, (SELECT sum(supply)::BIGINT FROM leaf) AS budget FROM leaf GROUP BY domain),
    b1 AS ({_SHARE.format(family="1", level="domain", nodes="n1")}),
    n2 AS (SELECT domain, lang, sum(leaf.held)::BIGINT AS held, {weight("lang")}, any_value(given)::BIGINT AS budget
        FROM leaf JOIN (SELECT domain, given FROM b1) b USING (domain) GROUP BY domain, lang),
    b2 AS ({_SHARE.format(family="domain", level="lang", nodes="n2")}),
    n3 AS (SELECT domain, lang, source, supply, leaf.held, {weight("source")}, given::BIGINT AS budget
        FROM leaf JOIN (SELECT domain, lang, given FROM b2) b USING (domain, lang)),
    b3 AS ({_SHARE.format(family="domain, lang", level="source", nodes="n3")}),
    e AS (SELECT domain, lang, source, (given // supply)::BIGINT AS whole_epochs, (given % supply)::BIGINT AS rest FROM b3),
    r AS (
        SELECT d.*, whole_epochs, rest, sum(tokens) OVER (PARTITION BY domain, lang, source
            ORDER BY md5('7|' || whole_epochs || '|' || doc_id), tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens AS before
        FROM d JOIN e USING (domain, lang, source) WHERE tokens > 0)
    SELECT doc_id, domain, lang, source, tokens, (whole_epochs + (before < rest)::INTEGER)::INTEGER AS epochs
    FROM r WHERE whole_epochs + (before < rest)::INTEGER > 0"""


@register("op2_mixing", _mix_sql())
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    taken = mixing.mix(docs.select("doc_id", "text", "lang", "source"), mix_levels(), MIX_WEIGHTS, mixing.word_count())
    return taken.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"),
                        F.col("mix_source").alias("source"), F.col("mix_tokens").alias("tokens"), F.col("mix_epochs").alias("epochs"))


@register("op3_near_dups")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op4_tokens")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.load(vocabulary_path("byte_bpe_50k.json")))


@register("op5_html_text")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@register("op6_sharding")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@register("op7_line_dedup", """
    WITH l AS (
        SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents),
    t AS (
        SELECT doc_id, text, pos, list_transform(
            string_split(trim(regexp_replace(line, '[\t\x0B\f\r ]+', ' ', 'g'), ' '), ' '),
            lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
        FROM l WHERE regexp_matches(line, '[^\t\x0B\f\r ]')),
    k AS (SELECT *, len(tokens) AS n, CASE WHEN len(tokens) > 50 THEN 2 ELSE 6 END AS need, (len(tokens) - 3) * 3 // 10 AS run FROM t),
    e AS (SELECT tokens FROM k GROUP BY tokens, need HAVING count(DISTINCT text) >= need),
    v AS (
        SELECT DISTINCT text, tokens, need, n, i, tokens[1:3 + i * run] AS front, tokens[4 + (i + 1) * run:] AS back
        FROM k, unnest(range(0, (n - 4) // run + 1)) u(i) WHERE run > 0),
    wide AS (SELECT n, i, front, back FROM v GROUP BY n, i, front, back, need HAVING count(DISTINCT text) >= need),
    bad AS (SELECT tokens FROM e UNION SELECT tokens FROM v JOIN wide USING (n, i, front, back)),
    gone AS (SELECT DISTINCT doc_id, text, pos FROM k JOIN bad USING (tokens)),
    stay AS (
        SELECT l.doc_id, l.text, string_agg(l.line, chr(10) ORDER BY l.pos) AS kept
        FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id, l.text),
    n AS (SELECT doc_id, count(*) AS n_dropped FROM gone GROUP BY doc_id)
    SELECT d.doc_id, coalesce(s.kept, CASE WHEN d.text IS NULL THEN NULL ELSE '' END) AS text,
        coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(n.n_dropped, 0) AS n_dropped
    FROM documents d LEFT JOIN stay s ON s.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op8_decontamination", """
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    p AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS phrase
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE len(w) > 0),
    g AS (
        SELECT doc_id, spot, n, w[spot:spot + n - 1] AS phrase
        FROM d, (SELECT DISTINCT n FROM p) s, unnest(range(1, len(w) - n + 2)) u(spot)),
    m AS (SELECT doc_id, item_id, spot, g.n FROM g JOIN p ON g.n = p.n AND g.phrase = p.phrase),
    hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + n)) AS word FROM m) GROUP BY doc_id),
    it AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


@register("op9_neighbours", """
    WITH v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
        FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@register("op10_quality")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@register("op11_alignment")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = token_ids.read_byte_level(vocabulary_path("byte_bpe_50k.json"))
    b = token_ids.read_pieces(vocabulary_path("piece_bpe_32k.model"))
    return alignment.alignments(table(spark, sf_dir, "documents"), a, b)


@register("op12_packing")
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), token_ids.read_byte_level(vocabulary_path("byte_bpe_50k.json")))


def _repair_sql() -> str:
    """The same search backwards over rows, on texts of six cost figures and the edits."""
    def put(edit: str, cost: str, way: str) -> str:
        return f"printf('%06d', substr({way}, 1, 6)::INTEGER + {cost}) || '{edit}' || substr({way}, 7)"

    wanted, steps = (2, 2, 3, 2), ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    options = []
    for q in range(4):
        keep = " ".join(f"WHEN '{c}' THEN {put('K', 'more', f'w{to}')}" for c, to in steps[q].items())
        options.append(f"least({put('D', '2', f'w{q}')}, CASE WHEN stays THEN {put('R', '1 + more', f'w{wanted[q]}')} END, "
                       f"CASE WHEN stays THEN CASE initial {keep} END END) AS f{q}")
    once = ", ".join(f"least(f{q}, {put('I', '5', f'f{wanted[q]}')}) AS g{q}" for q in range(4))
    twice = ", ".join(f"least(f{q}, {put('I', '5', f'g{wanted[q]}')}) AS w{q}" for q in range(4))
    same = "IS NOT DISTINCT FROM"
    return f"""
    WITH RECURSIVE o AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    h AS (
        SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT), lambda c, b:
            list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS hit FROM o),
    d AS (
        SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
            CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM h, (SELECT unnest([0, 1]) AS copy) WHERE hit <> 0 AND (copy = 0 OR hit = 3)),
    e AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d),
    m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM e),
    n AS (
        SELECT *, CASE WHEN last = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
            WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 4 END AS fault FROM m),
    r AS (
        SELECT *, left(role, 1) AS initial, fault > 2 AS stays, CASE fault WHEN 3 THEN 5 ELSE 0 END AS more,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM n),
    c AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
            count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
            count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
    walk AS (
        SELECT conv_id, n AS i, '000000' AS w0, '000010II' AS w1, '000005I' AS w2, '000000' AS w3 FROM c
        UNION ALL
        SELECT conv_id, i - 1, {twice} FROM (
            SELECT *, {once} FROM (
                SELECT w.conv_id, w.i, {", ".join(options)} FROM walk w JOIN r ON r.conv_id {same} w.conv_id AND r.i = w.i))),
    a AS (SELECT conv_id, substr(w0, 1, 6)::BIGINT AS cost, substr(w0, 7) AS audit FROM walk WHERE i = 0),
    made AS (
        SELECT conv_id, audit, 1::BIGINT AS p, 1::BIGINT AS i, 0 AS q, '' AS repaired FROM a
        UNION ALL
        SELECT m.conv_id, audit, p + 1, m.i + (edit <> 'I')::INTEGER,
            CASE WHEN edit = 'D' THEN q WHEN edit = 'K' AND r.initial = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END,
            CASE WHEN edit = 'D' THEN repaired ELSE repaired || chr(10) || CASE WHEN edit = 'K' THEN r.role WHEN q = 2 THEN 'assistant' ELSE 'user' END
                || ':' || CASE WHEN edit = 'I' THEN '' ELSE r.text END END
        FROM (SELECT *, substr(audit, p, 1) AS edit FROM made WHERE p <= length(audit)) m
        LEFT JOIN r ON r.conv_id {same} m.conv_id AND r.i = m.i)
    SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(a.cost, 0) AS cost, coalesce(a.audit, '') AS audit,
        sha256(coalesce(substr(repaired, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN c ON c.conv_id {same} g.conv_id LEFT JOIN a ON a.conv_id {same} g.conv_id
    LEFT JOIN made m ON m.conv_id {same} g.conv_id AND p = length(m.audit) + 1"""


@register("op13_conversations", _repair_sql())
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.with_digests(conversations.repair(rows, present=F.col("there")))


@register("pipeline")
def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
