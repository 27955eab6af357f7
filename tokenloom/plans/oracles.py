"""SQL twins of the queries, for DuckDB over the same tables.

They share parameters with the queries but no code: every step is spelled out
again in SQL.
"""

from __future__ import annotations

from tokenloom.plans.queries import (
    BATCH,
    CUT_PIECES,
    DROPPED_PIECES,
    LEFT_OUT,
    MAX_IDS,
    MIN_SCORE,
    MIN_USAGE,
    NEW_SIZE,
    STEP_RATE,
    TOP_WORDS,
)

CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"
MARK = r"\p{P}$+<=>^\x60|~"
TOKEN = rf"[{CJK}]|[{MARK}]|[^\s{MARK}{CJK}]+"


def _r(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def _norm(col: str = "text") -> str:
    return f"strip_accents(lower({col}))"


def _counts(table: str) -> str:
    return (
        f"SELECT token, count(*)::BIGINT AS frequency FROM (SELECT unnest(regexp_extract_all({_norm()}, '{TOKEN}')) AS token "
        f"FROM {table}) GROUP BY token"
    )


# Building blocks as common table expressions, in the order they depend on each other.
CTE: dict[str, str] = {
    "counts": _counts("documents"),
    "merged": f"SELECT * FROM counts UNION ALL ({_counts('benchmark')}) UNION ALL ({_counts('conversations')})",
    "chars": f"SELECT DISTINCT c FROM (SELECT unnest(string_split(token, '')) AS c FROM counts) WHERE c <> '{LEFT_OUT}'",
    "top": f"""SELECT token FROM counts WHERE length(token) > 1
        ORDER BY frequency DESC, token LIMIT {TOP_WORDS}""",
    "pieces": """SELECT piece, (row_number() OVER (ORDER BY kind, piece) - 1)::INT AS id FROM (
        SELECT 0 AS kind, '[UNK]' AS piece UNION ALL SELECT 1, c FROM chars
        UNION ALL SELECT 2, '##' || c FROM chars UNION ALL SELECT 3, token FROM top)""",
    "weights": """SELECT p.id, i AS pos, (e.embedding[i + 1])::DOUBLE AS w
        FROM pieces p JOIN embeddings e ON e.vec_id = p.id % (SELECT count(*) FROM embeddings),
        range(0, 64) r(i)""",
    "words": "SELECT DISTINCT token AS word FROM merged",
    "model": "SELECT piece, id FROM pieces",
    "best": """SELECT word, s, max(n) AS n, arg_max(id, n) AS id FROM (
        SELECT word, s, n, id FROM words, range(1, length(word) + 1) a(s),
          range(1, least(length(word) - s + 1, 30) + 1) b(n)
        JOIN model ON piece = (CASE WHEN s > 1 THEN '##' ELSE '' END) || substring(word, s, n)
        WHERE length(word) <= 100) GROUP BY word, s""",
    "walk": """SELECT word, 1::BIGINT AS s, 0 AS k, NULL::INT AS id, 0::BIGINT AS n FROM words WHERE length(word) <= 100
        UNION ALL SELECT w.word, w.s + b.n, w.k + 1, b.id, b.n FROM walk w JOIN best b ON b.word = w.word AND b.s = w.s""",
    "done": "SELECT word FROM walk WHERE s = length(word) + 1",
    "split": """SELECT word, k, id, n FROM walk WHERE k > 0 AND word IN (SELECT word FROM done)
        UNION ALL SELECT word, 1, (SELECT id FROM model WHERE piece = '[UNK]'), length(word) FROM words
        WHERE word NOT IN (SELECT word FROM done)""",
    "tok": f"""SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (
        SELECT doc_id, regexp_extract_all({_norm()}, '{TOKEN}') AS t FROM documents)""",
    "ids": """SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) AS rn
        FROM tok JOIN split USING (word)""",
    "used": "SELECT doc_id, id, count(*)::DOUBLE AS n FROM ids GROUP BY doc_id, id",
    "encoded": """SELECT doc_id, pos, sum(n * w) / sum(n) AS value FROM used JOIN weights USING (id) GROUP BY doc_id, pos""",
    "teacher": """SELECT d.doc_id, i AS pos, (e.embedding[i + 1])::DOUBLE AS t FROM documents d
        JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings), range(0, 64) r(i)""",
    "pair": "SELECT doc_id, pos, value AS s, t FROM encoded JOIN teacher USING (doc_id, pos)",
    "student": "SELECT doc_id, list(s ORDER BY pos) AS s, list(t ORDER BY pos) AS t FROM pair GROUP BY doc_id",
    "batches": f"SELECT *, ((row_number() OVER (ORDER BY doc_id) - 1) // {BATCH})::BIGINT AS batch_id FROM student",
    "centre": """SELECT label, list(c ORDER BY pos) AS v FROM (
        SELECT label, i AS pos, avg((embedding[i + 1])::DOUBLE) AS c FROM embeddings, range(0, 64) r(i) GROUP BY label, i)
        GROUP BY label""",
    "usage": """SELECT p.piece, p.id, coalesce(u.usage, 0)::BIGINT AS usage FROM pieces p LEFT JOIN (
        SELECT s.id, sum(c.frequency) AS usage FROM {source} c JOIN split s ON s.word = c.token GROUP BY s.id) u USING (id)""",
    "kept": f"""SELECT piece, (row_number() OVER (ORDER BY id) - 1)::INT AS id FROM usage
        WHERE usage >= {MIN_USAGE} OR piece IN ('[UNK]', '[PAD]')""",
    "added": f"""SELECT token AS piece, ((SELECT max(id) FROM {{base}}) + row_number() OVER (ORDER BY f DESC, token))::INT AS id
        FROM (SELECT token, max(frequency) AS f FROM {{source}} WHERE NOT regexp_matches(token, '^\\p{{{{Nd}}}}+$')
          AND token NOT IN (SELECT piece FROM {{base}}) GROUP BY token)
        QUALIFY row_number() OVER (ORDER BY f DESC, token) <= {NEW_SIZE} - (SELECT count(*) FROM {{base}})""",
}
NEEDS = {
    "merged": ["counts"],
    "chars": ["counts"],
    "top": ["counts"],
    "pieces": ["chars", "top"],
    "weights": ["pieces"],
    "words": ["merged"],
    "model": ["pieces"],
    "best": ["words", "model"],
    "walk": ["best"],
    "done": ["walk"],
    "split": ["done"],
    "ids": ["tok", "split"],
    "used": ["ids"],
    "encoded": ["used", "weights"],
    "pair": ["encoded", "teacher"],
    "student": ["pair"],
    "batches": ["student"],
    "usage": ["split"],
    "kept": ["usage"],
    "added": ["pieces", "merged"],
}


def _with(query: str, *blocks: str, **replaced: str) -> str:
    """Put the needed blocks in front of a query; ``replaced`` swaps a block for another text."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for block in blocks:
        add(block)
    parts = [f"{name} AS ({replaced.get(name, CTE[name])})" for name in order]
    return f"WITH RECURSIVE {', '.join(parts)} {query}"


def _usage(source: str) -> str:
    return CTE["usage"].format(source=source)


def _added(base: str, source: str = "merged") -> str:
    return CTE["added"].format(base=base, source=source)


def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity(({a})::DOUBLE[], ({b})::DOUBLE[])"


def _ndcg() -> str:
    return f"""WITH c AS ({CTE['centre']}),
      hits AS (SELECT c.label, e.vec_id, e.label AS l, row_number() OVER (PARTITION BY c.label
          ORDER BY round({_cos('c.v', 'e.embedding')}, 6) DESC, e.vec_id) AS rank FROM c, embeddings e),
      dcg AS (SELECT label, sum(CASE WHEN l = label THEN (vec_id % 3 + 1) / log2(rank + 1) ELSE 0 END) AS dcg
          FROM hits WHERE rank <= 10 GROUP BY label),
      ideal AS (SELECT label, sum(rel / log2(rank + 1)) AS idcg FROM (SELECT label, vec_id % 3 + 1 AS rel,
          row_number() OVER (PARTITION BY label ORDER BY vec_id % 3 DESC, vec_id) AS rank FROM embeddings)
          WHERE rank <= 10 GROUP BY label)
      SELECT CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS dataset, {_r('avg(dcg / idcg)')} AS ndcg,
        count(*)::BIGINT AS n_queries FROM dcg JOIN ideal USING (label) GROUP BY 1"""


def _dims() -> str:
    return "(VALUES (16), (32), (64)) v(dim)"


def _contrastive(batches: str, group: str, s: str, t: str) -> str:
    """Per row: log-sum-exp over the batch minus the row's own score."""
    return f"""SELECT {group}, a.doc_id, ln(sum(exp({_cos(f'a.{s}', f'b.{t}')} / 0.07)))
        - max(CASE WHEN a.doc_id = b.doc_id THEN {_cos(f'a.{s}', f'b.{t}')} / 0.07 END) AS loss
        FROM {batches} a JOIN {batches} b USING ({group}) GROUP BY {group}, a.doc_id"""


def all_oracles() -> dict[str, str]:
    embedded = "documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)"
    turn_pairs = """(SELECT a.conv_id, a.turn, unnest([0, 1])::BIGINT AS pos, unnest([a.text, b.text]) AS text
        FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""
    strip = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
    raw = rf"\s*(?:[{MARK}]|[^\s{MARK}]+)"
    cut_to = CUT_PIECES - 2

    def long(cols: str, vector: str, source: str, dims: int = 64) -> str:
        return f"SELECT {cols}, i::BIGINT AS pos, {_r(f'({vector}[i + 1])::DOUBLE')} AS value FROM {source}, range(0, {dims}) r(i)"

    def truncated(source: str) -> str:
        """End offset of the last kept piece, then the text up to there."""
        return f"""rawtok AS (SELECT doc_id, unnest(r) AS raw, generate_subscripts(r, 1) AS pos FROM (
            SELECT doc_id, regexp_extract_all(text, '{raw}') AS r FROM {source})),
          placed AS (SELECT doc_id, pos, length(raw) AS raw_len, length(regexp_extract(raw, '^\\s*')) AS lead,
            sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY pos) - length(raw) AS before FROM rawtok),
          ends AS (SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.pos, s.k) AS rn,
            CASE WHEN p.raw_len - p.lead = length(t.word) THEN p.before + p.lead
              + sum(s.n) OVER (PARTITION BY p.doc_id, p.pos ORDER BY s.k) ELSE p.before + p.raw_len END AS stop
            FROM placed p JOIN tok t USING (doc_id, pos) JOIN split s ON s.word = t.word),
          stops AS (SELECT doc_id, max(stop) AS stop FROM ends WHERE rn <= {cut_to} GROUP BY doc_id)"""

    tokens_in_text = _with("", "tok", "split")
    cut_documents = f"(SELECT doc_id, lang, substring({strip}, 1, 10000) AS text FROM documents)"
    clean_tok = CTE["tok"].replace("FROM documents", f"FROM {cut_documents}")
    out: dict[str, str] = {
        "read_shards_s1": long("doc_id::VARCHAR AS doc_id, sha256(text) AS text", "embedding", embedded),
        "shard_row_count_s2": f"SELECT count(*)::BIGINT AS n_rows, true AS within_limit FROM {embedded}",
        "training_view_s3": long("sha256(text) AS sentence", "embedding", embedded),
        "write_shards_s4": long("doc_id::VARCHAR AS doc_id, lang", "embedding", embedded),
        "pair_by_position_s5": long(
            "shard, row, sha256(text) AS text",
            "embedding",
            f"""(SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS row
              FROM (SELECT doc_id, text, embedding, coalesce(lang, 'none') AS shard FROM {embedded}))""",
        ),
        "stream_shards_s6": "SELECT doc_id, text, lang FROM documents",
        "dataset_model_name_s7": f"SELECT 'stored-vectors' AS model_name, (2 * count(*))::BIGINT AS n_rows FROM {embedded}",
        "dataset_profile_s8": "SELECT count(*)::BIGINT AS n_rows, min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim, "
        "sum(8 + 4 * len(embedding) + 4)::BIGINT AS n_bytes, 'vec_id: bigint, embedding: array<float>, label: int' AS columns FROM embeddings",
        "dataset_facts_s8": f"""SELECT 'stored-vectors' AS model_name, 'documents' AS dataset_name, count(*)::BIGINT AS n_rows, 64::BIGINT AS dim,
            'doc_id: string, text: string, lang: string, embedding: array<float>' AS columns, true AS bytes_agree FROM {embedded}""",
        "write_vocabulary_s9": _with(
            "SELECT word AS token, count(*)::BIGINT AS frequency, count(DISTINCT doc_id)::BIGINT AS document_frequency FROM tok GROUP BY word",
            "tok",
        ),
        "text_field_p1": "SELECT text FROM conversations",
        "join_array_text_p2": f"""SELECT doc_id, len(l)::BIGINT AS n_lines, array_to_string(l, ' ') AS text FROM (
            SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) WHERE length({strip}) > 0""",
        "unpivot_first_seen_p3": f"""SELECT * FROM {turn_pairs}
            QUALIFY row_number() OVER (PARTITION BY text ORDER BY conv_id, turn, pos) = 1""",
        "unpivot_text_p4": f"SELECT * FROM {turn_pairs}",
        "union_subsets_p5": "SELECT text FROM documents UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM conversations",
        "rename_and_prune_p6": "SELECT html AS text FROM pages",
        "source_catalog_p7": " UNION ALL ".join(
            f"SELECT '{t}' AS source, count(*)::BIGINT AS n_rows, sum(length({c}))::BIGINT AS n_chars FROM {t}"
            for t, c in [("documents", "text"), ("benchmark", "text"), ("conversations", "text"), ("pages", "url")]
        ),
        "limit_batches_p8": f"SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT {3 * BATCH}",
        "assign_batches_p9": f"SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) // {BATCH})::BIGINT AS batch_id FROM events",
        "shuffle_rows_p10": "SELECT doc_id, text FROM documents",
        "origin_names_p11": "SELECT page_id, regexp_extract(url, '[^/]*$') AS short_name, replace(url, '/', '__') AS path_name FROM pages",
        "clean_cut_t1": f"SELECT doc_id, substring({strip}, 1, 10000) AS text FROM documents",
        "bert_normalize_t2": rf"SELECT doc_id, regexp_replace({_norm()}, '[\t\n\r]', ' ', 'g') AS text FROM documents",
        "pretokenize_t3": _with("SELECT doc_id, (pos - 1)::BIGINT AS pos, word AS token FROM tok", "tok"),
        "wordpiece_t4": _with(
            "SELECT word, string_agg(id::VARCHAR, ' ' ORDER BY k) AS ids FROM split GROUP BY word",
            "split",
            words="SELECT token AS word FROM counts",
        ),
        "truncate_words_t5": rf"""SELECT doc_id, regexp_extract(substring({strip}, 1, 10000), '^(?:{raw}){{0,{MAX_IDS}}}') AS text
            FROM documents""",
        "truncate_pieces_t6": tokens_in_text + ", " + truncated("documents")
        + " SELECT doc_id, substring(text, 1, coalesce(stop, 0)::BIGINT) AS text FROM documents LEFT JOIN stops USING (doc_id)",
        "encode_ids_t7": _with(
            f"""SELECT doc_id, count(*)::BIGINT AS n, string_agg(id::VARCHAR, ' ' ORDER BY rn) AS ids FROM ids
            WHERE rn <= {MAX_IDS} GROUP BY doc_id""",
            "ids",
        ),
        "lowercase_vocab_t8": """SELECT lower(piece) AS piece, min(doc_id) AS id FROM (
            SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS piece FROM documents) GROUP BY 1""",
        "token_counts_v1": _counts("documents"),
        "document_frequency_v2": _with(
            "SELECT word AS token, count(DISTINCT doc_id)::BIGINT AS document_frequency FROM tok GROUP BY word", "tok"
        ),
        "merge_vocabularies_v3": _with("SELECT token, frequency FROM merged", "merged"),
        "piece_usage_v4": _with("SELECT piece, id, usage FROM usage", "usage", usage=_usage("merged")),
        "prune_vocab_v5": _with("SELECT piece, id FROM kept", "kept", usage=_usage("counts")),
        "add_top_tokens_v6": _with(
            "SELECT piece, id FROM pieces UNION ALL SELECT piece, id FROM added", "added", added=_added("pieces")
        ),
        "expand_vocab_v7": _with(
            "SELECT piece, id FROM kept UNION ALL SELECT piece, id FROM added",
            "kept",
            "added",
            usage=_usage("merged"),
            added=_added("kept"),
        ),
    }

    gone = ", ".join(f"'{p}'" for p in DROPPED_PIECES)
    align = {
        "added": _added("pieces", "counts"),
        "model": f"SELECT piece, id FROM pieces WHERE piece NOT IN ({gone})",
        "words": "SELECT regexp_replace(piece, '^##', '') AS word FROM pieces UNION SELECT piece FROM added",
    }
    aligned = """aligned AS (SELECT n.piece, n.id, coalesce([e.id], [l.id], s.ids) AS ids,
          CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN l.id IS NOT NULL THEN 'stripped' ELSE 'encoded' END AS match_kind
        FROM (SELECT * FROM pieces UNION ALL SELECT * FROM added) n
        LEFT JOIN model e ON e.piece = n.piece
        LEFT JOIN model l ON l.piece = regexp_replace(n.piece, '^##', '')
        LEFT JOIN (SELECT word, list(id ORDER BY k) AS ids FROM split GROUP BY word) s ON s.word = regexp_replace(n.piece, '^##', ''))"""
    aligned = aligned.replace("coalesce([e.id], [l.id], s.ids)", "CASE WHEN e.id IS NOT NULL THEN [e.id] WHEN l.id IS NOT NULL THEN [l.id] ELSE s.ids END")
    out["align_vocab_e1"] = (
        _with("", "pieces", "added", "split", **align) + ", " + aligned
        + " SELECT piece, id, array_to_string(ids, ' ') AS ids, match_kind FROM aligned"
    )
    out["init_weights_e2"] = (
        _with("", "weights", "added", "split", **align) + ", " + aligned
        + f" SELECT a.id, pos::BIGINT AS pos, {_r('avg(w)')} AS value FROM (SELECT id, unnest(ids) AS old FROM aligned) a"
        " JOIN weights x ON x.id = a.old GROUP BY a.id, pos"
    )
    out["embed_corpus_e3"] = (
        _with("", "tok", "split", tok=clean_tok) + ", " + truncated(cut_documents)
        + f""", cut AS (SELECT doc_id, lang, substring(text, 1, coalesce(stop, 0)::BIGINT) AS text
            FROM {cut_documents} LEFT JOIN stops USING (doc_id))
          SELECT doc_id, lang, text, length(text)::DOUBLE AS v0, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS v1,
            (length(text) - length(replace(text, 'e', '')))::DOUBLE AS v2,
            (length(text) - length(replace(text, ' ', '')))::DOUBLE AS v3 FROM cut"""
    )
    encoded = _with(f"SELECT doc_id, pos::BIGINT AS pos, {_r('value')} AS value FROM encoded", "encoded")
    out["static_encode_e4"] = encoded
    out["l2_normalize_e5"] = f"""SELECT vec_id, i::BIGINT AS pos, {_r('(embedding[i + 1])::DOUBLE / norm')} AS value FROM (
        SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE))) AS norm
        FROM embeddings), range(0, 16) r(i)"""
    scored = f"""WITH c AS ({CTE['centre']}) SELECT c.label::BIGINT AS query_id, e.vec_id AS doc_id,
        {_r(_cos('c.v', 'e.embedding'))} AS score FROM c, embeddings e"""
    out["cosine_scores_e6"] = f"{scored} WHERE c.label = e.label OR c.label = (e.label + 1) % 10"
    out["similar_scores_e6"] = f"SELECT * FROM ({scored}) WHERE score >= {MIN_SCORE}"
    out["nearest_k_e7"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT
        AS rank FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {_r(_cos('q.embedding', 'd.embedding'))} AS score
        FROM embeddings q, embeddings d)) WHERE rank <= 10"""
    out["cells_search_e7"] = out["nearest_k_e7"]
    turn_tok = f"""SELECT conv_id || '-' || turn AS doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (
        SELECT conv_id, turn, regexp_extract_all({_norm()}, '{TOKEN}') AS t FROM conversations WHERE role = 'user')"""
    out["route_encode_e8"] = _with(
        f"""SELECT c.conv_id, c.turn, c.role, i::BIGINT AS pos, {_r('coalesce(e.value, 0)')} AS value FROM conversations c
        CROSS JOIN range(0, 64) r(i) LEFT JOIN encoded e ON e.doc_id = c.conv_id || '-' || c.turn AND e.pos = i WHERE role = 'user'
        UNION ALL SELECT c.conv_id, c.turn, c.role, i::BIGINT, {_r('(e.embedding[i + 1])::DOUBLE')}
        FROM conversations c JOIN embeddings e ON e.vec_id = c.conv_id % (SELECT count(*) FROM embeddings), range(0, 64) r(i)
        WHERE role <> 'user'""",
        "encoded",
        tok=turn_tok,
    )
    every_turn = turn_tok.replace(" WHERE role = 'user'", "")
    out["exported_encode_e4"] = _with(
        f""", lens AS (SELECT doc_id, sqrt(sum(value * value)) AS m FROM encoded GROUP BY doc_id)
        SELECT c.conv_id, c.turn, i::BIGINT AS pos, {_r('coalesce(e.value / l.m, 0)')} AS value FROM conversations c
        CROSS JOIN range(0, 64) r(i) LEFT JOIN encoded e ON e.doc_id = c.conv_id || '-' || c.turn AND e.pos = i
        LEFT JOIN lens l ON l.doc_id = e.doc_id""",
        "encoded",
        tok=every_turn,
    )
    routed = f""", q AS (SELECT c.conv_id, c.turn, list(coalesce(e.value, 0) ORDER BY i) AS v FROM conversations c
          CROSS JOIN range(0, 64) r(i) LEFT JOIN encoded e ON e.doc_id = c.conv_id || '-' || c.turn AND e.pos = i
          WHERE role = 'user' GROUP BY c.conv_id, c.turn),
        s AS (SELECT q.conv_id, q.turn, e.vec_id, {_r(_cos('q.v', 'e.embedding'))} AS score FROM q, embeddings e),
        hits AS (SELECT conv_id, turn, doc_id, score,
            row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, doc_id)::BIGINT AS rank
          FROM s JOIN documents d ON d.doc_id % (SELECT count(*) FROM embeddings) = s.vec_id QUALIFY rank <= 10)"""
    out["routed_search"] = _with(routed + " SELECT conv_id, turn, doc_id, score, rank FROM hits", "encoded", tok=turn_tok)
    out["routed_ndcg"] = _with(
        routed
        + f""", n AS (SELECT count(*) AS n FROM embeddings),
        dcg AS (SELECT conv_id, turn, sum(CASE WHEN doc_id % n = conv_id % n THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
          FROM hits, n GROUP BY conv_id, turn),
        sizes AS (SELECT doc_id % n AS vec_id, count(*) AS c FROM documents, n GROUP BY 1),
        ideal AS (SELECT vec_id, (SELECT sum(1 / log2(i + 1)) FROM range(1, least(c, 10)::INT + 1) r(i)) AS idcg FROM sizes)
        SELECT 'turn ' || least(turn, 3) AS dataset, {_r('avg(dcg / idcg)')} AS ndcg, count(*)::BIGINT AS n_queries
        FROM dcg, n JOIN ideal ON vec_id = conv_id % n GROUP BY 1""",
        "encoded",
        tok=turn_tok,
    )
    letters = """length({c})::DOUBLE {v0}, (length({c}) - length(replace({c}, 'a', '')))::DOUBLE {v1},
        (length({c}) - length(replace({c}, 'e', '')))::DOUBLE {v2}, (length({c}) - length(replace({c}, ' ', '')))::DOUBLE {v3}"""
    bare = letters.format(c="bare", v0="", v1="", v2="", v3="")
    out["init_from_teacher_e2"] = _with(
        f"""SELECT id, i::BIGINT AS pos, {_r('v[i + 1]')} AS value FROM (SELECT id, [{bare}] AS v FROM (
        SELECT id, CASE WHEN starts_with(piece, '##') THEN substring(piece, 3) ELSE piece END AS bare FROM pieces)), range(0, 4) r(i)""",
        "pieces",
    )
    out["align_special_e1"] = (
        _with("", "pieces", "added", "split", **align) + ", "
        + aligned.replace("ELSE s.ids END", "ELSE list_concat([0], s.ids, [0, 1]) END")
        + " SELECT piece, id, array_to_string(ids, ' ') AS ids, match_kind FROM aligned"
    )
    sources = """(SELECT 'benchmark' AS source, item_id * 1000000 AS doc_id, text FROM benchmark
        UNION ALL SELECT 'conversations', -(conv_id * 1000 + turn) - 1, text FROM conversations)"""
    cut_sources = f"(SELECT source, doc_id, substring({strip}, 1, 10000) AS text FROM {sources})"
    out["embed_sources_e3_s4"] = (
        _with("", "tok", "split", tok=CTE["tok"].replace("FROM documents", f"FROM {cut_sources}")) + ", "
        + truncated(cut_sources).replace(f"rn <= {cut_to}", f"rn <= {510}")
        + f""", cut AS (SELECT source, substring(text, 1, coalesce(stop, 0)::BIGINT) AS text FROM {cut_sources} LEFT JOIN stops USING (doc_id))
        SELECT source, text, {letters.format(c='text', v0='AS v0', v1='AS v1', v2='AS v2', v3='AS v3')} FROM cut"""
    )
    out["check_dims_e9"] = "SELECT 64::BIGINT AS dim, count(*)::BIGINT AS n_rows FROM documents"
    out["slice_dims_e10"] = long("vec_id", "embedding", "embeddings", 16)

    out["cosine_loss_d1"] = _with(f"SELECT {_r('1 - avg(' + _cos('s', 't') + ')')} AS loss FROM student", "student")
    out["contrastive_loss_d2"] = _with(
        f"SELECT batch_id, {_r('avg(loss)')} AS loss FROM ({_contrastive('batches', 'batch_id', 's', 't')}) GROUP BY batch_id",
        "batches",
    )
    out["matryoshka_loss_d3"] = _with(
        f"SELECT dim::BIGINT AS dim, {_r('1 - avg(' + _cos('s[1:dim]', 't[1:dim]') + ')')} AS loss FROM student, {_dims()} GROUP BY dim",
        "student",
    )
    out["matryoshka_contrastive_d3"] = _with(
        f""", cut AS (SELECT batch_id, dim, doc_id, s[1:dim] AS s, t[1:dim] AS t FROM batches, {_dims()})
        SELECT dim::BIGINT AS dim, {_r('avg(loss)')} AS loss FROM (
          SELECT dim, batch_id, avg(loss) AS loss FROM ({_contrastive('cut', 'dim, batch_id', 's', 't')}) GROUP BY dim, batch_id)
        GROUP BY dim""",
        "batches",
    )
    out["gradient_step_d4"] = _with(
        f""", norms AS (SELECT doc_id, sqrt(sum(s * s)) AS m, sqrt(sum(t * t)) AS y, sum(s * t) AS st FROM pair GROUP BY doc_id),
        grad AS (SELECT doc_id, pos, -(t / y - st / (m * y) * s / m) / m AS g FROM pair JOIN norms USING (doc_id)),
        sizes AS (SELECT doc_id, sum(n) AS total FROM used GROUP BY doc_id),
        steps AS (SELECT u.id, g.pos, sum(g.g * u.n / z.total) AS step FROM grad g JOIN used u USING (doc_id)
          JOIN sizes z USING (doc_id) GROUP BY u.id, g.pos)
        SELECT w.id, w.pos::BIGINT AS pos, {_r(f'w.w - {STEP_RATE} * coalesce(s.step, 0) / (SELECT count(*) FROM norms)')} AS value
        FROM weights w LEFT JOIN steps s USING (id, pos)""",
        "pair",
        "used",
        "weights",
    )

    fit, source = [], "weights"
    for k in (1, 2):
        fit.append(f"""enc{k} AS (SELECT doc_id, pos, sum(n * w) / sum(n) AS s FROM used JOIN {source} USING (id) GROUP BY doc_id, pos),
          pair{k} AS (SELECT doc_id, pos, s, t FROM enc{k} JOIN teacher USING (doc_id, pos)),
          norms{k} AS (SELECT doc_id, sqrt(sum(s * s)) AS m, sqrt(sum(t * t)) AS y, sum(s * t) AS st FROM pair{k} GROUP BY doc_id),
          grad{k} AS (SELECT doc_id, pos, -(t / y - st / (m * y) * s / m) / m AS g FROM pair{k} JOIN norms{k} USING (doc_id)),
          steps{k} AS (SELECT u.id, g.pos, sum(g.g * u.n / z.total) AS step FROM grad{k} g JOIN used u USING (doc_id)
            JOIN sizes z USING (doc_id) GROUP BY u.id, g.pos),
          w{k} AS (SELECT id, pos, w - {STEP_RATE} * coalesce(step, 0) / (SELECT count(*) FROM documents) AS w
            FROM {source} LEFT JOIN steps{k} USING (id, pos))""")
        source = f"w{k}"
    out["fit_weights_d4"] = _with(
        ", sizes AS (SELECT doc_id, sum(n) AS total FROM used GROUP BY doc_id), " + ", ".join(fit)
        + f" SELECT id, pos::BIGINT AS pos, {_r('w')} AS value FROM w2",
        "teacher",
        "used",
        "weights",
    )

    out["fit_resumed_d4"] = out["fit_weights_d4"]
    fit.append("enc3 AS (SELECT doc_id, pos, sum(n * w) / sum(n) AS s FROM used JOIN w2 USING (id) GROUP BY doc_id, pos)")
    fit.append("pair3 AS (SELECT doc_id, pos, s, t FROM enc3 JOIN teacher USING (doc_id, pos))")
    for k in (1, 2, 3):
        fit.append(f"""agreed{k} AS (SELECT avg(c) AS c FROM (SELECT sum(s * t) / (sqrt(sum(s * s)) * sqrt(sum(t * t))) AS c
          FROM pair{k} GROUP BY doc_id))""")
    out["fit_history_d4"] = _with(
        ", sizes AS (SELECT doc_id, sum(n) AS total FROM used GROUP BY doc_id), " + ", ".join(fit)
        + " UNION ALL ".join(
            f" SELECT {k}::BIGINT AS step, {STEP_RATE}::DOUBLE AS rate, {_r(f'1 - agreed{k}.c')} AS loss, {_r(f'agreed{k + 1}.c')} AS mean_cosine FROM agreed{k}, agreed{k + 1}"
            for k in (1, 2)
        ),
        "teacher",
        "used",
        "weights",
    )

    ranked = """SELECT score, gold, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rs,
        rank() OVER (ORDER BY gold) + (count(*) OVER (PARTITION BY gold) - 1) / 2.0 AS rg FROM p"""
    out["sts_correlation_m1"] = f"""WITH p AS (SELECT round({_cos('a.embedding', 'b.embedding')}, 6) AS score,
        (a.label = b.label)::INT::DOUBLE AS gold FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
        SELECT {_r('corr(score, gold)')} AS pearson, {_r('corr(rs, rg)')} AS spearman FROM ({ranked})"""
    out["ndcg_at_k_m2"] = _ndcg()
    out["compare_models_m3"] = f"""WITH c AS ({CTE['centre']}),
        m AS (SELECT label::BIGINT AS dataset, avg({_cos('e.embedding', 'c.v')}) AS teacher,
          avg({_cos('e.embedding[1:16]', 'c.v[1:16]')}) AS student FROM embeddings e JOIN c USING (label) GROUP BY label)
        SELECT dataset, {_r('teacher')} AS teacher, {_r('student')} AS student, {_r('teacher - student')} AS gap FROM m"""
    out["mean_agreement_m4"] = _with(
        f"SELECT {_r('avg(' + _cos('s', 't') + ')')} AS mean_cosine, count(*)::BIGINT AS n FROM student", "student"
    )

    def hits(part: str) -> str:
        return f"""SELECT q.vec_id AS query_id, d.vec_id AS doc_id FROM embeddings q, embeddings d
            QUALIFY row_number() OVER (PARTITION BY q.vec_id
            ORDER BY round({_cos(f'q.embedding{part}', f'd.embedding{part}')}, 6) DESC, d.vec_id) <= 10"""

    out["list_overlap_m4"] = f"""WITH a AS ({hits('[1:16]')}), b AS ({hits('')})
        SELECT a.query_id, count(b.doc_id) / 10.0::DOUBLE AS overlap FROM a LEFT JOIN b USING (query_id, doc_id) GROUP BY a.query_id"""

    out["stream_token_counts_x1"] = out["token_counts_v1"]
    out["stream_encode_x2"] = encoded
    out["stream_write_shards_x3"] = long("vec_id::VARCHAR AS vec_id", "embedding", "embeddings")
    out["stream_first_seen_x4"] = "SELECT DISTINCT text FROM documents"
    out["stream_first_seen_within_x4"] = "SELECT DISTINCT user_id, event_type FROM events"
    out["stream_shuffle_p10"] = "SELECT doc_id, text, true AS mixed FROM documents"
    asked = """(SELECT text, row_number() OVER (ORDER BY text) AS query_id, f[1] AS conv_id, f[2] AS turn FROM (
        SELECT text, min([conv_id, turn]) AS f FROM conversations WHERE role = 'user' GROUP BY text))"""
    ask_tok = f"""SELECT -query_id - 1 AS doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (
        SELECT query_id, regexp_extract_all({_norm()}, '{TOKEN}') AS t FROM {asked}) UNION ALL {CTE['tok']}"""
    out["nearest_documents"] = _with(
        f""", v AS (SELECT doc_id, list(value ORDER BY pos) AS v FROM encoded GROUP BY doc_id),
        scored AS (SELECT -q.doc_id - 1 AS query_id, d.doc_id, {_r(_cos('q.v', 'd.v'))} AS score FROM v q, v d
          WHERE q.doc_id < 0 AND d.doc_id >= 0)
        SELECT a.conv_id, a.turn, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank
        FROM scored JOIN {asked} a USING (query_id) QUALIFY rank <= 10""",
        "encoded",
        tok=ask_tok,
    )
    return out
