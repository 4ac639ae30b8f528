"""Ordered-row, chunking and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from litquarry.functions.core import md5_order
from litquarry.operators import chunking as ck, windows as wn
from litquarry.plans.registry import query
from litquarry.plans.retrieval_queries import SECTION_RANK_SQL
from litquarry.plans.views import chunks, docs, labelled, sql
from litquarry.sources.tables import table

c = F.col


@query("w1_priority_chunks", sql(f"""SELECT * FROM (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY {SECTION_RANK_SQL}, chunk_id) AS chunk_rank
    FROM chunks) WHERE chunk_rank <= 3""", "lines", "chunks"))
def w1(spark, d):
    return wn.priority_chunks(chunks(spark, d), 3).select("document_id", "chunk_id", "chunk_rank")


@query("w6_next_sequence", """WITH old AS (SELECT * FROM conversations WHERE turn < 2), new AS (SELECT * FROM conversations WHERE turn >= 2)
    SELECT conv_id, turn, coalesce((SELECT max(turn) + 1 FROM old o WHERE o.conv_id=new.conv_id), 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq_no FROM new""")
def w6(spark, d):
    t = table(spark, d, "conversations", "conv_id", "turn")
    return wn.next_sequence(t.where("turn < 2").withColumn("seq_no", c("turn") + 1), t.where("turn >= 2"), "conv_id", "seq_no", ["turn"])


@query("w7_last_messages", """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n
    FROM conversations) WHERE n <= 3""")
def w7(spark, d):
    return wn.last_messages(table(spark, d, "conversations", "conv_id", "turn", "role"), "conv_id", "turn", 3)


@query("w15_message_window", """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n
    FROM conversations) WHERE n <= 20""")
def w15(spark, d):
    return wn.last_messages(table(spark, d, "conversations", "conv_id", "turn"), "conv_id", "turn", 20)


@query("w13_stratified_sample", sql("""SELECT document_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || document_id), document_id) AS n FROM labelled)
    WHERE n <= CASE label WHEN 'RELEVANT' THEN 60 WHEN 'DISTRACTOR' THEN 20 ELSE 20 END""", "labelled"))
def w13(spark, d):
    return wn.stratified_sample(labelled(spark, d), "label", {"RELEVANT": 60, "DISTRACTOR": 20, "IRRELEVANT": 20}, md5_order("document_id", 7), "document_id")


@query("w9_fixed_count_windows", sql("""SELECT document_id, w + 1 AS window_no, min(pos) AS first_pos, max(pos) AS last_pos, CAST(sum(length(text)) AS BIGINT) AS chars FROM
    (SELECT document_id, text, pos, n, unnest(range(greatest(0, (pos - 2) // 7 - 1), (pos - 1) // 7 + 1)) AS w FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS pos,
     count(*) OVER (PARTITION BY document_id) AS n FROM chunks)) WHERE pos BETWEEN w * 7 + 1 AND w * 7 + 8 AND (w = 0 OR w * 7 + 1 < n) GROUP BY ALL""", "lines", "chunks"))
def w9_fixed(spark, d):
    """No character bound, so windows start every seven chunks and the result has a closed form."""
    return ck.analysis_windows(chunks(spark, d), 8, 10**9, 1)


def _walk_sql(limit: int, most: int, nxt: str) -> str:
    """Windows by walking from each window's start to the next one; ``nxt`` gives it from s and e, positions from 1."""
    return sql("""SELECT document_id, window_no, s AS first_pos, e AS last_pos, CAST(chars AS BIGINT) AS chars FROM walk""", "lines", "chunks", extra=f"""
    sized AS (SELECT document_id, row_number() OVER w AS pos, length(text) AS size, sum(length(text)) OVER w AS upto, count(*) OVER (PARTITION BY document_id) AS n
      FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index, chunk_id)),
    ends AS (SELECT a.document_id, a.pos AS s, max(b.pos) AS e, max(b.upto) - a.upto + a.size AS chars, a.n FROM sized a JOIN sized b ON a.document_id = b.document_id
      AND b.pos BETWEEN a.pos AND a.pos + {limit - 1} AND (b.pos = a.pos OR b.upto - a.upto + a.size <= {most}) GROUP BY a.document_id, a.pos, a.upto, a.size, a.n),
    walk AS (SELECT document_id, 1::BIGINT AS window_no, s, e, chars, n FROM ends WHERE s = 1
      UNION ALL SELECT x.document_id, window_no + 1, x.s, x.e, x.chars, x.n FROM walk w JOIN ends x ON x.document_id = w.document_id AND x.s = {nxt} WHERE w.e < w.n)""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("w9_bounded_windows", _walk_sql(8, 1000, "greatest(w.s + 1, w.e)"))
def w9(spark, d):
    return ck.analysis_windows(chunks(spark, d), 8, 1000, 1)


@query("w11_source_batches", _walk_sql(12, 1500, "w.e + 1"))
def w11(spark, d):
    return ck.source_batches(chunks(spark, d).withColumn("size", F.length("text")), ["chunk_index", "chunk_id"], "size", 12, 1500)


@query("w10_static_batches", sql("""SELECT document_id, batch_no, chunk_id, bool_or(ctx) AS is_context FROM (
    SELECT document_id, unnest(list_distinct([(pos-1)//12, (pos-2)//12, pos//12])) AS batch_no, chunk_id, FALSE AS ctx, n FROM p WHERE TRUE
    UNION ALL SELECT document_id, unnest(range(0, (n-1)//12+1)), chunk_id, TRUE, n FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS r FROM p WHERE t) WHERE r <= 6
    UNION ALL SELECT document_id, unnest(range(0, (n-1)//12+1)), chunk_id, TRUE, n FROM p WHERE pos <= 2 AND document_id NOT IN (SELECT document_id FROM p WHERE t))
    WHERE batch_no BETWEEN 0 AND (n-1)//12 GROUP BY ALL""", "lines", "chunks", extra="""p AS (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS pos,
    count(*) OVER (PARTITION BY document_id) AS n, regexp_matches(lower(section_path), 'abstract|method|result') AS t FROM chunks)"""))
def w10(spark, d):
    return ck.static_batches(chunks(spark, d))


def units(spark, d):
    """Sentences of each line as chunk units; every third line belongs to a second section."""
    from litquarry.functions.cells import sentences
    t = chunks(spark, d)
    u = t.select("document_id", c("chunk_index").alias("paragraph"), F.when(c("chunk_index") % 3 == 2, "Results").otherwise("Body").alias("section_path"),
                 F.posexplode(sentences("text")).alias("sentence", "text"))
    return u.select("document_id", (c("paragraph") * 100_000 + c("sentence")).cast("long").alias("ord"), F.lit("body").alias("content_type"), "section_path",
                    "paragraph", "sentence", "text")


# Sentences as units with their sizes; sizes of a run come from running sums, its end is the unit before the first that does not fit.
# Sentences longer than a chunk are first cut at white space in the same way.
PACKING = rf"""
    cut AS (SELECT document_id, chunk_index AS paragraph, CASE WHEN chunk_index % 3 = 2 THEN 'Results' ELSE 'Body' END AS section_path,
      list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\s*\n+\s*', '. ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM chunks),
    u0 AS (SELECT document_id, section_path, paragraph, generate_subscripts(l, 1) - 1 AS sentence, unnest(l) AS text FROM cut),
    u2 AS (SELECT *, paragraph::BIGINT * 100000 + sentence AS ord, length(regexp_replace(text, '[\x00-\x7F]+', '', 'g')) AS wide, length('Section: ' || section_path) + 1 AS head FROM u0),
    u3 AS (SELECT *, ceil((head + length(text) - wide) / 4.0) + wide > {ck.MAX_TOKENS} AS too_long FROM u2),
    words0 AS (SELECT document_id, ord, head, generate_subscripts(l, 1) AS i, unnest(l) AS word FROM (SELECT *, string_split_regex(text, '\s+') AS l FROM u3 WHERE too_long)),
    words1 AS (SELECT *, length(regexp_replace(word, '[\x00-\x7F]+', '', 'g')) AS ww FROM words0),
    words AS (SELECT *, length(word) - ww + 1 AS wa, sum(length(word) - ww + 1) OVER w AS ua, sum(ww) OVER w AS uw FROM words1 WINDOW w AS (PARTITION BY document_id, ord ORDER BY i)),
    parts0 AS (SELECT x.document_id, x.ord, x.i, max(y.i) AS j FROM words x JOIN words y ON x.document_id = y.document_id AND x.ord = y.ord AND y.i BETWEEN x.i AND x.i + 2 * {ck.MAX_TOKENS}
      AND (y.i = x.i OR ceil((x.head + y.ua - x.ua + x.wa - 1) / 4.0) + y.uw - x.uw + x.ww <= {ck.MAX_TOKENS}) GROUP BY ALL),
    parts AS (SELECT *, 0 AS part FROM parts0 WHERE i = 1 UNION ALL SELECT x.*, part + 1 FROM parts p JOIN parts0 x ON x.document_id = p.document_id AND x.ord = p.ord AND x.i = p.j + 1),
    pieces AS (SELECT p.document_id, p.ord, p.part, string_agg(w.word, ' ' ORDER BY w.i) AS piece FROM parts p JOIN words w ON w.document_id = p.document_id AND w.ord = p.ord AND w.i BETWEEN p.i AND p.j GROUP BY ALL),
    u1 AS (SELECT document_id, section_path, paragraph, sentence, ord, 0 AS part, head, text, wide FROM u3 WHERE NOT too_long
      UNION ALL SELECT document_id, section_path, paragraph, sentence, ord, p.part, head, piece, length(regexp_replace(piece, '[\x00-\x7F]+', '', 'g')) FROM u3 JOIN pieces p USING (document_id, ord)),
    u AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY document_id, section_path) AS n, sum(length(text) - wide + 1) OVER w AS ca, sum(wide) OVER w AS cw,
      length(text) - wide + 1 AS a FROM u1 WINDOW w AS (PARTITION BY document_id, section_path ORDER BY ord, part)),
    grown AS (SELECT x.document_id, x.section_path, x.pos AS s, y.pos AS q, ceil((x.head + y.ca - x.ca + x.a - 1) / 4.0) + y.cw - x.cw + x.wide AS t,
      ceil((x.head + y.ca - y.a - x.ca + x.a - 1) / 4.0) + y.cw - y.wide - x.cw + x.wide AS before
      FROM u x JOIN u y ON x.document_id = y.document_id AND x.section_path = y.section_path AND y.pos > x.pos),
    fits AS (SELECT *, t <= {ck.TARGET_TOKENS} OR (t <= {ck.MAX_TOKENS} AND before < {ck.TARGET_TOKENS // 2}) AS ok FROM grown),
    step AS (SELECT u.document_id, u.section_path, u.pos AS s, k, u.n, coalesce(min(q) FILTER (NOT ok AND q >= u.pos + k) - 1, u.n) AS e FROM u CROSS JOIN (VALUES (1), (2)) v(k)
      LEFT JOIN fits f ON f.document_id = u.document_id AND f.section_path = u.section_path AND f.s = u.pos GROUP BY u.document_id, u.section_path, u.pos, k, u.n),
    pair AS (SELECT document_id, section_path, s, t > {ck.MAX_TOKENS} AS too_big FROM grown WHERE q = s + 1),
    nxt AS (SELECT step.*, CASE WHEN too_big THEN e + 1 ELSE greatest(step.s, e) END AS s2, CASE WHEN too_big THEN 1 ELSE 2 END AS k2
      FROM step LEFT JOIN pair p ON p.document_id = step.document_id AND p.section_path = step.section_path AND p.s = step.e),
    walk AS (SELECT document_id, section_path, 1::BIGINT AS chunk_no, s, e, n, s2, k2 FROM nxt WHERE s = 1 AND k = 1
      UNION ALL SELECT x.document_id, x.section_path, chunk_no + 1, x.s, x.e, x.n, x.s2, x.k2 FROM walk w JOIN nxt x
      ON x.document_id = w.document_id AND x.section_path = w.section_path AND x.s = w.s2 AND x.k = w.k2 WHERE w.e < w.n),
    packed AS (SELECT w.document_id, w.section_path, w.chunk_no, min(u.ord) AS first_ord, arg_min(u.paragraph, u.pos) AS paragraph, CAST(arg_min(u.sentence, u.pos) AS INT) AS sentence_start,
      CAST(arg_max(u.sentence, u.pos) AS INT) AS sentence_end, CAST(count(*) AS INT) AS n_units, string_agg(u.text, ' ' ORDER BY u.pos) AS text
      FROM walk w JOIN u ON u.document_id = w.document_id AND u.section_path = w.section_path AND u.pos BETWEEN w.s AND w.e GROUP BY w.document_id, w.section_path, w.chunk_no),
    sec AS (SELECT document_id, section_path, count(*) AS chunks, min(first_ord) AS f FROM packed GROUP BY 1, 2),
    off AS (SELECT *, sum(chunks) OVER (PARTITION BY document_id ORDER BY f, section_path) - chunks AS before FROM sec)"""


@query("d3_sentence_packing_chunks", sql("""SELECT p.document_id, 'body' AS content_type, p.section_path, chunk_no, first_ord, paragraph, sentence_start, sentence_end, n_units, text,
    CAST(before + chunk_no AS BIGINT) AS chunk_index, p.document_id || ':' || CAST(before + chunk_no AS BIGINT) AS chunk_id
    FROM packed p JOIN off USING (document_id, section_path)""", "lines", "chunks", extra=PACKING).replace("WITH ", "WITH RECURSIVE ", 1))
def d3(spark, d):
    return ck.chunk(units(spark, d))


@query("t6_context_budget", sql("""SELECT document_id, chunk_id, chars_before FROM (SELECT document_id, chunk_id, coalesce(sum(least(length(text), 120)) OVER (PARTITION BY document_id ORDER BY chunk_index
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before FROM chunks) WHERE chars_before < 600""", "lines", "chunks"))
def t6(spark, d):
    return wn.clip_to_budget(chunks(spark, d), "document_id", "chunk_index", "text", 120, 600).select("document_id", "chunk_id", "chars_before")
