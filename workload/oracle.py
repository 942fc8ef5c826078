"""The registered queries in SQL, as DuckDB runs it on the same tables."""

from __future__ import annotations

from sentloom.operators.sampling import TRIES
from workload import fixtures as fx
from workload.queries import NS_BATCH, NS_K, NS_LENGTH, TOTAL_WEIGHTS

ORACLES: dict[str, str] = {}

SPACE = r"[ \t\n\x0b\f\r]+"
BREAK = r"[.!?]+\s+|\n+"
PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"  # one quote doubled for SQL
WORD = (
    r"[\p{L}\p{M}\p{N}]+(?:[''’-][\p{L}\p{M}\p{N}]+)*"
    r"|[^\p{L}\p{M}\p{N}\s\x0B]"
)


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACE}'), lambda t: t <> '')"


def r6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def outline(v: str) -> str:
    d = f"CAST({v} AS DOUBLE[])"
    weighted = f"list_sum(list_transform({d}, lambda x, i: x * ((i - 1) % 7 + 1)))"
    return (
        f"{r6(f'({d})[1]')} AS v_first, {r6(f'({d})[-1]')} AS v_last, "
        f"{r6(f'list_dot_product({d}, {d})')} AS v_square, {r6(weighted)} AS v_weighted"
    )


def joined(lst: str, sep: str = " ") -> str:
    return f"coalesce(array_to_string({lst}, '{sep}'), '')"


def zero_pad(lst: str, width: str) -> str:
    return f"list_resize({lst}, {width}, 0)"


# Shared table expressions, by name; each may use the ones before it.
CTES = {
    "sent": f"""
        SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS text
        FROM (SELECT doc_id, string_split_regex(lower(text), '{BREAK}') AS a FROM documents)""",
    "corpus": f"SELECT doc_id, pos, text, {tokens('text')} AS tokens FROM sent",
    "wc": """
        SELECT word, count(*) AS n FROM (SELECT unnest(tokens) AS word FROM corpus)
        GROUP BY word""",
    "vocab": f"""
        SELECT word, max(id) AS id FROM (
            SELECT '<eos>' AS word, 0 AS id UNION ALL SELECT '<unk>', 1
            UNION ALL
            SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 1 AS INTEGER)
            FROM (SELECT * FROM wc ORDER BY n DESC, word LIMIT {fx.NUM_WORDS - 2}))
        GROUP BY word""",
    "wv": """
        SELECT word, id, embedding AS v FROM vocab JOIN embeddings ON id = vec_id""",
    "turns": f"""
        SELECT conv_id, turn, role, text, {tokens('lower(text)')} AS tokens
        FROM conversations""",
    "tpairs": """
        SELECT * FROM (
            SELECT conv_id, turn, lower(text) AS s1,
                   lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS s2
            FROM conversations) WHERE s2 IS NOT NULL""",
    "spairs": """
        SELECT * FROM (
            SELECT s.doc_id, s.pos, d.lang, s.text AS s1,
                   lead(s.text) OVER (PARTITION BY s.doc_id ORDER BY s.pos) AS s2,
                   CAST(l.quality AS DOUBLE) AS score
            FROM sent s JOIN documents d ON s.doc_id = d.doc_id
            JOIN labels l ON s.doc_id = l.doc_id)
        WHERE s2 IS NOT NULL""",
    "trip": """
        SELECT doc_id, pos, p AS decode_pre, tokens AS encode, s AS decode_post FROM (
            SELECT doc_id, pos, tokens,
                   lag(tokens) OVER (PARTITION BY doc_id ORDER BY pos) AS p,
                   lead(tokens) OVER (PARTITION BY doc_id ORDER BY pos) AS s
            FROM corpus)
        WHERE len(p) BETWEEN 1 AND 29 AND len(tokens) BETWEEN 1 AND 29
          AND len(s) BETWEEN 1 AND 29""",
    "vp": f"""
        SELECT vec_id AS id, CAST(embedding[1:{fx.HALF}] AS DOUBLE[]) AS x,
               CAST(embedding[{fx.HALF + 1}:{2 * fx.HALF}] AS DOUBLE[]) AS y
        FROM embeddings""",
    "bp": f"""
        SELECT *, rk // {fx.BATCH} AS batch, CAST(rk % {fx.BATCH} AS INTEGER) AS row,
               count(*) OVER (PARTITION BY rk // {fx.BATCH}) AS size
        FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rk FROM vp)""",
}
NEEDS = {
    "corpus": ["sent"],
    "wc": ["corpus"],
    "vocab": ["wc"],
    "wv": ["vocab"],
    "spairs": ["sent"],
    "trip": ["corpus"],
    "bp": ["vp"],
}


def _closure(names: list[str]) -> list[str]:
    found: list[str] = []
    for name in names:
        for need in _closure(NEEDS.get(name, [])) + [name]:
            if need not in found:
                found.append(need)
    return found


def sql(name: str, uses: list[str], body: str, **extra: str) -> None:
    """Register ``body`` with the table expressions it uses; ``extra`` are its own ones."""
    parts = [(n, CTES[n]) for n in _closure(uses)] + list(extra.items())
    head = ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in parts)
    ORACLES[name] = f"WITH {head}\n{body}" if parts else body


def ids_of(source: str, keys: str, column: str, oov: str, table: str = "vocab") -> str:
    """(keys, ids): the ids of a token column, in order; empty lists stay."""
    value = "coalesce(v.id, 1)" if oov == "unk" else "v.id"
    keep = "t.word IS NOT NULL" + ("" if oov == "unk" else " AND v.id IS NOT NULL")
    on = " AND ".join(f"g.{k} = s.{k}" for k in keys.split(", "))
    return f"""
        SELECT {', '.join('s.' + k for k in keys.split(', '))},
               coalesce(g.ids, CAST([] AS INTEGER[])) AS ids
        FROM {source} s LEFT JOIN (
            SELECT {keys}, list({value} ORDER BY i) FILTER ({keep}) AS ids
            FROM (SELECT {keys}, unnest({column}) AS word, unnest(range(len({column}))) AS i
                  FROM {source}) t
            LEFT JOIN {table} v ON t.word = v.word
            GROUP BY {keys}) g ON {on}"""


# --- sources and text ---------------------------------------------------------------------

sql("sentences", ["sent"], "SELECT doc_id, pos, text FROM sent")
sql("sentence_files", ["sent"], """
    SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS rank, text FROM sent""")
sql("scored_files", ["spairs"], """
    SELECT replace(s1, chr(9), ' ') AS s1, replace(s2, chr(9), ' ') AS s2, score FROM spairs""")
ORACLES["scored_files_header"] = ORACLES["scored_files"]
sql(
    "ws_tokens",
    ["corpus"],
    f"SELECT doc_id, pos, CAST(len(tokens) AS INTEGER) AS n, {joined('tokens')} AS tokens FROM corpus",
)
sql(
    "space_tokens",
    [],
    f"""SELECT conv_id, turn, CAST(len(a) AS INTEGER) AS n, {joined('a', '|')} AS tokens
        FROM (SELECT conv_id, turn, string_split(lower(text), ' ') AS a FROM conversations)""",
)
sql(
    "clean_caption",
    [],
    f"""SELECT doc_id, CAST(len(a) AS INTEGER) AS n, {joined('a')} AS tokens FROM (
        SELECT doc_id, {tokens(f"lower(translate(text, '{PUNCT}', ''))")} AS a FROM documents)""",
)
sql(
    "tokenize",
    [],
    f"""SELECT doc_id, CAST(len(a) AS INTEGER) AS n, {joined('a')} AS tokens FROM (
        SELECT doc_id, list_append(regexp_extract_all(lower(text), '{WORD}'), '<eos>') AS a
        FROM documents)""",
)
sql(
    "tagged_tokens",
    [],
    f"""SELECT doc_id, CAST(len(a) AS INTEGER) AS n, {joined('a')} AS tokens FROM (
        SELECT doc_id, list_transform(
            list_filter({tokens('text')}, lambda t: NOT contains(t, '/')
                        AND regexp_matches(source[1:2], '^[A-Za-z]+$')),
            lambda t: lower(t) || '/' || source[1:2]) AS a
        FROM documents)""",
)
for _name, _sep in (("captions_tab", "\t"), ("captions_spaces", "    ")):
    sql(
        _name,
        [],
        f"""SELECT conv_id, turn, string_split(line, '{_sep}')[1] AS clip_id,
               {joined(tokens(f"coalesce(string_split(line, '{_sep}')[2], '')"))} AS tokens
        FROM (SELECT conv_id, turn, CASE WHEN role = 'system' THEN replace(text, '{_sep}', '')
                     ELSE conv_id || '{_sep}' || text END AS line FROM conversations)""",
    )
sql("pair_lines", ["tpairs"], r"""
    SELECT conv_id, turn, string_split(line, '	')[1] AS s1,
           string_split(line, '	')[2] AS s2
    FROM (SELECT conv_id, turn, regexp_replace(s1 || '	' || s2 || chr(10), '\r?\n$', '') AS line
          FROM tpairs)""")
_LABELLED = f"""
    SELECT doc_id, pos, label AS obj_id,
           {tokens(f"lower(translate(text, '{PUNCT}', ''))")} AS tokens
    FROM sent JOIN embeddings ON doc_id = vec_id"""
sql(
    "labelled_onehot",
    ["sent"],
    f"""SELECT doc_id, pos, obj_id, {joined('tokens')} AS tokens,
           array_to_string(list_transform(range(80),
                           lambda i: CASE WHEN i = obj_id THEN '1' ELSE '0' END), '') AS one_hot
        FROM lab""",
    lab=_LABELLED,
)
sql(
    "union_domains",
    ["spairs"],
    "SELECT doc_id, pos, lang AS domain, s1, s2, score FROM spairs",
)

# --- vocabulary ---------------------------------------------------------------------------

sql("word_counts_all", ["wc"], "SELECT word, n FROM wc")
sql("vocabulary", ["vocab"], "SELECT word, id FROM vocab")
_LINES = """
    SELECT row_number() OVER (ORDER BY conv_id, turn, i) - 1 AS pos, word
    FROM (SELECT conv_id, turn, unnest(tokens) AS word, unnest(range(len(tokens))) AS i
          FROM turns)"""
sql(
    "vocabulary_file",
    ["turns"],
    "SELECT word, CAST(min(pos) AS INTEGER) AS id FROM lines GROUP BY word",
    lines=_LINES,
)
sql(
    "embedding_file",
    ["turns"],
    f"""SELECT word, id, {outline('v')} FROM (
        SELECT word, CAST(min(pos) AS INTEGER) AS id, arg_max(embedding, pos) AS v
        FROM lines JOIN embeddings ON pos = vec_id GROUP BY word)""",
    lines=_LINES,
)
sql(
    "shared_vocabulary",
    ["corpus", "turns"],
    "SELECT unnest(tokens) AS word FROM corpus INTERSECT SELECT unnest(tokens) FROM turns",
)
sql(
    "zipf",
    ["vocab"],
    """SELECT word, id, round((ln(id + 2) - ln(id + 1))
                              / ln((SELECT count(*) FROM vocab) + 1), 9) AS p FROM vocab""",
)

# --- ids and triples ----------------------------------------------------------------------

sql(
    "encode_ids_unk",
    ["vocab"],
    f"SELECT doc_id, pos, {joined('ids')} AS ids FROM coded",
    coded=ids_of("corpus", "doc_id, pos", "tokens", "unk"),
)
sql(
    "encode_ids_drop",
    ["vocab"],
    f"SELECT doc_id, pos, {joined('list_append(ids, 0)')} AS ids FROM coded",
    coded=ids_of("corpus", "doc_id, pos", "tokens", "drop"),
)
_PARTS = ("decode_pre", "encode", "decode_post")
sql("triples", ["trip"], f"""
    SELECT doc_id, pos, {', '.join(f'{joined(p)} AS {p}' for p in _PARTS)} FROM trip""")
for _name, _oov, _ids in (
    ("triples_ids", "unk", "ids"),
    ("sentence_row_triples", "drop", "list_append(ids, 0)"),
):
    sql(
        _name,
        ["vocab", "trip"],
        f"""SELECT t.doc_id, t.pos, {joined('a.ids')} AS decode_pre, {joined('b.ids')} AS encode,
               {joined('c.ids')} AS decode_post
            FROM trip t JOIN fin a ON a.doc_id = t.doc_id AND a.pos = t.pos - 1
            JOIN fin b ON b.doc_id = t.doc_id AND b.pos = t.pos
            JOIN fin c ON c.doc_id = t.doc_id AND c.pos = t.pos + 1""",
        coded=ids_of("corpus", "doc_id, pos", "tokens", _oov),
        fin=f"SELECT doc_id, pos, {_ids} AS ids FROM coded",
    )
sql("turn_triples", ["turns"], f"""
    SELECT conv_id, turn, {joined('p')} AS decode_pre, {joined('tokens')} AS encode,
           {joined('s')} AS decode_post
    FROM (SELECT conv_id, turn, tokens,
                 lag(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS p,
                 lead(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM turns)
    WHERE len(p) BETWEEN 1 AND 199 AND len(tokens) BETWEEN 1 AND 199
      AND len(s) BETWEEN 1 AND 199""")
for _name, _source, _key, _order, _max in (
    ("corpus_stats", "corpus", "doc_id", "pos", 30),
    ("turn_stats", "turns", "conv_id", "turn", 60),
):
    sql(_name, [_source], f"""
        SELECT count(*) AS sentences_seen,
               count(*) FILTER (ok) AS sentences_considered,
               count(*) FILTER (ok AND NOT short) AS sentences_too_long,
               count(*) FILTER (ok AND short) AS sentences_output
        FROM (SELECT len(p) > 0 AND len(t) > 0 AND len(s) > 0 AS ok,
                     len(p) < {_max} AND len(t) < {_max} AND len(s) < {_max} AS short
              FROM (SELECT lag(tokens) OVER w AS p, tokens AS t, lead(tokens) OVER w AS s
                    FROM {_source} WINDOW w AS (PARTITION BY {_key} ORDER BY {_order})))""")
sql("pair_stats", ["tpairs"], f"""
    SELECT count(*) AS sentences_considered,
           count(*) FILTER (NOT short) AS sentences_too_long,
           count(*) FILTER (short) AS sentences_output
    FROM (SELECT len({tokens('s1')}) < 30 AND len({tokens('s2')}) < 30 AS short FROM tpairs)""")
sql("first_triples", ["trip"], f"""
    SELECT doc_id, pos, {joined('encode')} AS encode FROM trip ORDER BY doc_id, pos LIMIT 1000""")

# --- captions and pairs -------------------------------------------------------------------

sql("captions_capped", ["corpus"], f"""
    SELECT doc_id AS clip_id, pos, {joined('tokens')} AS tokens
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM corpus)
    WHERE rn <= 40 AND len(tokens) < 30""")
sql("caption_stats", ["corpus"], """
    SELECT (SELECT count(*) FROM corpus) AS sentences_seen,
           count(*) AS sentences_considered,
           count(*) FILTER (len(tokens) >= 30) AS sentences_too_long,
           count(*) FILTER (len(tokens) < 30) AS sentences_output
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM corpus)
    WHERE rn <= 40 AND doc_id IN (SELECT vec_id FROM embeddings)""")
sql(
    "captions_features",
    ["vocab"],
    f"""SELECT c.doc_id AS clip_id, c.pos, {joined('list_append(k.ids, 0)')} AS sentence,
           {outline('e.embedding')}
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM corpus) c
        JOIN coded k ON k.doc_id = c.doc_id AND k.pos = c.pos
        JOIN embeddings e ON e.vec_id = c.doc_id
        WHERE rn <= 40 AND len(tokens) < 30""",
    coded=ids_of("corpus", "doc_id, pos", "tokens", "drop"),
)
sql(
    "captions_clips",
    ["vocab"],
    f"""SELECT c.doc_id AS clip_id, c.pos, f.n AS nb_frames, {joined('k.ids')} AS encode,
           {outline('f.clip')}
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM corpus) c
        JOIN coded k ON k.doc_id = c.doc_id AND k.pos = c.pos
        JOIN (SELECT rk // 8 AS clip_id, count(*) AS n,
                     flatten(list(embedding ORDER BY rk)) AS clip
              FROM (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS rk
                    FROM embeddings) GROUP BY rk // 8) f ON f.clip_id = c.doc_id
        WHERE rn <= 40 AND len(tokens) < 30""",
    coded=ids_of("corpus", "doc_id, pos", "tokens", "unk"),
)
sql("captions_positional", [], f"""
    SELECT conv_id, turn, position, i.doc_id, {outline('e.embedding')}
    FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS position
          FROM conversations)
    JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM labels) i
      USING (position)
    JOIN (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS doc_id, embedding FROM embeddings) e
      ON e.doc_id = i.doc_id""")
sql(
    "pairs_ids",
    ["vocab", "tpairs"],
    f"""SELECT conv_id, turn, {joined('list_append(a.ids, 0)')} AS s1,
           {joined('list_append(b.ids, 0)')} AS s2
        FROM short JOIN a USING (conv_id, turn) JOIN b USING (conv_id, turn)""",
    short=f"""SELECT conv_id, turn, {tokens('s1')} AS t1, {tokens('s2')} AS t2 FROM tpairs
              WHERE len({tokens('s1')}) < 60 AND len({tokens('s2')}) < 60""",
    a=ids_of("short", "conv_id, turn", "t1", "drop"),
    b=ids_of("short", "conv_id, turn", "t2", "drop"),
)
sql(
    "labelled_ids",
    ["vocab"],
    f"""SELECT doc_id, pos, {joined('list_append(ids, 0)')} AS encode,
               {r6('obj_id')} AS label
        FROM coded JOIN lab USING (doc_id, pos) WHERE len(tokens) < 30""",
    lab=_LABELLED,
    coded=ids_of("lab", "doc_id, pos", "tokens", "drop"),
)
sql("caption_pairs", ["sent"], """
    SELECT * FROM (SELECT doc_id, pos, text AS s1,
                          lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS s2 FROM sent)
    WHERE s2 IS NOT NULL""")

# --- order, split, shards, batches ----------------------------------------------------------

_SHUFFLED = """
    SELECT doc_id, pos, row_number() OVER (
        ORDER BY md5('123:' || doc_id || ':' || pos), doc_id, pos) - 1 AS rk,
        count(*) OVER () AS total FROM sent"""
sql(
    "train_validation_split",
    ["sent"],
    "SELECT doc_id, pos, CASE WHEN rk < 5000 THEN 'validation' ELSE 'train' END AS split FROM sh",
    sh=_SHUFFLED,
)
sql(
    "shards",
    ["sent"],
    """SELECT doc_id, pos, split, r.rank, CAST(i AS INTEGER) AS shard
       FROM r JOIN borders b ON b.s = r.split AND r.rank >= b.lo AND r.rank < b.hi""",
    sh=_SHUFFLED,
    r="""SELECT doc_id, pos, CASE WHEN rk < 5000 THEN 'validation' ELSE 'train' END AS split,
                CASE WHEN rk < 5000 THEN rk ELSE rk - 5000 END AS rank FROM sh""",
    borders="""
        SELECT split AS s, i, i * n // k AS lo, (i + 1) * n // k AS hi
        FROM (SELECT split, count(*) AS n, CASE split WHEN 'train' THEN 100 ELSE 1 END AS k
              FROM r GROUP BY split), range(100) t(i) WHERE i < k""",
)


def _split(rows: str, first: int) -> str:
    return f"""
        SELECT *, CASE WHEN row_number() OVER (
            ORDER BY md5('123:' || doc_id || ':' || pos), doc_id, pos) <= {first}
            THEN 'validation' ELSE 'train' END AS split FROM {rows}"""


sql(
    "stored_images",
    ["vocab"],
    f"""SELECT split, {joined('list_append(ids, 0)')} AS sentence, {outline('embedding')}
        FROM placed""",
    capped="""SELECT doc_id, pos, tokens, embedding FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM corpus)
        JOIN embeddings ON vec_id = doc_id WHERE rn <= 40 AND len(tokens) < 30""",
    coded=ids_of("capped", "doc_id, pos", "tokens", "drop"),
    rows="SELECT * FROM capped JOIN coded USING (doc_id, pos)",
    placed=_split("rows", 100),
)
sql(
    "stored_labels",
    ["vocab"],
    f"""SELECT split, {joined('list_append(ids, 0)')} AS encode, {r6('obj_id')} AS feature
        FROM placed""",
    lab=_LABELLED,
    coded=ids_of("lab", "doc_id, pos", "tokens", "drop"),
    rows="SELECT * FROM coded JOIN lab USING (doc_id, pos) WHERE len(tokens) < 30",
    placed=_split("rows", 100),
)
sql("stored_vocabulary", ["vocab"], """
    SELECT 'count' AS kind, word, n FROM wc UNION ALL SELECT 'id', word, id FROM vocab""")
sql(
    "stored_records",
    ["vocab", "tpairs"],
    f"""SELECT {joined('a.ids')} AS s1, {joined('b.ids')} AS s2
        FROM a JOIN b USING (conv_id, turn)""",
    toks=f"SELECT conv_id, turn, {tokens('s1')} AS t1, {tokens('s2')} AS t2 FROM tpairs",
    a=ids_of("toks", "conv_id, turn", "t1", "unk"),
    b=ids_of("toks", "conv_id, turn", "t2", "unk"),
)
sql("batches", ["sent"], """
    SELECT doc_id, pos, rk // 128 AS batch, CAST(rk % 128 AS INTEGER) AS row
    FROM (SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS rk FROM sent)""")
sql("permuted_features", [], f"""
    SELECT a.vec_id, {outline('b.embedding')}
    FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rk FROM embeddings) a
    JOIN (SELECT embedding, row_number() OVER (ORDER BY md5('123:' || vec_id), vec_id) AS rk
          FROM embeddings) b USING (rk)""")

# --- arrays ---------------------------------------------------------------------------------

sql(
    "padded_ids",
    ["vocab"],
    f"""SELECT doc_id, pos, CAST(width AS INTEGER) AS width,
           {joined(zero_pad('ids', 'width'))} AS ids,
           repeat('1', len(ids)) || repeat('0', width - len(ids)) AS mask
        FROM (SELECT *, max(len(ids)) OVER (PARTITION BY rk // 128) AS width
              FROM (SELECT *, row_number() OVER (ORDER BY doc_id, pos) - 1 AS rk FROM coded))""",
    coded=ids_of("corpus", "doc_id, pos", "tokens", "drop"),
)


def _eval(name: str, source: str, keys: str, extra: str, width: int, oov: str, split) -> None:
    def padded(side: str) -> str:
        ones = f"least(len({side}.ids), {width})"
        mask = f"list_transform(range({width}), lambda i: CASE WHEN i < {ones} THEN 1 ELSE 0 END)"
        return f"{joined(zero_pad(f'{side}.ids', str(width)))}, {joined(mask)}"

    a_ids, a_mask = padded("a").split(", coalesce(array_to_string(list_transform", 1)
    b_ids, b_mask = padded("b").split(", coalesce(array_to_string(list_transform", 1)
    head = "coalesce(array_to_string(list_transform"
    cols = ", ".join("toks." + k for k in keys.split(", "))
    sql(
        name,
        ["vocab", source],
        f"""SELECT {cols}{extra}, {a_ids} AS s1_ids, {head}{a_mask} AS s1_mask,
               {b_ids} AS s2_ids, {head}{b_mask} AS s2_mask
            FROM toks JOIN a USING ({keys}) JOIN b USING ({keys})""",
        toks=f"""SELECT *, {split('lower(s1)')} AS t1, {split('lower(s2)')} AS t2
                 FROM {source}""",
        a=ids_of("toks", keys, "t1", oov),
        b=ids_of("toks", keys, "t2", oov),
    )


_eval("eval_arrays", "spairs", "doc_id, pos", ", score", 50, "unk", tokens)
_eval(
    "eval_arrays_drop", "tpairs", "conv_id, turn", "", 70, "drop",
    lambda t: f"string_split({t}, ' ')",
)
sql(
    "shifted_ids",
    ["vocab", "turns"],
    f"""SELECT conv_id, turn,
           {joined("CASE WHEN len(ids) > 0 THEN list_concat([0], ids[1:len(ids) - 1]) ELSE ids END")}
           AS input, ids[-1] AS last FROM coded""",
    coded=ids_of("turns", "conv_id, turn", "tokens", "unk"),
)
sql("regrouped", [], f"""
    SELECT vec_id, 4 AS steps, {r6('embedding[33]')} AS third_step, {outline('m')}
    FROM (SELECT vec_id, embedding, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i:
            CASE WHEN ((i - 1) // 16) % 2 = 0 THEN x ELSE 0.0 END) AS m FROM embeddings)""")

# --- vectors ----------------------------------------------------------------------------------

sql(
    "word_vectors",
    ["wv", "turns"],
    f"""SELECT conv_id, turn, CAST(i AS INTEGER) AS i,
           {outline("coalesce(wv.v, (SELECT v FROM wv WHERE word = '<unk>'))")}
        FROM (SELECT conv_id, turn, unnest(tokens) AS word, unnest(range(len(tokens))) AS i
              FROM turns) t LEFT JOIN wv ON t.word = wv.word""",
)
sql(
    "id_vectors",
    ["vocab", "turns"],
    f"""SELECT conv_id, turn, CAST(i AS INTEGER) AS i,
           {outline("coalesce(embedding, list_transform(range(64), lambda k: 0))")}
        FROM (SELECT conv_id, turn, unnest(ids) AS id, unnest(range(len(ids))) AS i
              FROM coded) LEFT JOIN embeddings ON id = vec_id""",
    coded=ids_of("turns", "conv_id, turn", "tokens", "unk"),
)


def summed(source: str, keys: str, v: str, dims: int, fn: str = "sum") -> str:
    """(keys, v): element-wise aggregate of a vector column."""
    return f"""
        SELECT {keys}, list(s ORDER BY d) AS v FROM (
            SELECT {keys}, d, {fn}(x) AS s FROM (
                SELECT {keys}, unnest(CAST({v} AS DOUBLE[])) AS x, unnest(range({dims})) AS d
                FROM {source}) GROUP BY {keys}, d) GROUP BY {keys}"""


sql(
    "mean_pool",
    [],
    f"""SELECT label, n, {outline('v')} FROM m
        JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)""",
    m=summed("embeddings", "label", "embedding", 64, "avg"),
)
sql(
    "padded_clips",
    [],
    f"""SELECT batch, CAST(n AS INTEGER) AS n, 640 AS padded, {r6('square')} AS flat_square,
               {r6('coalesce(second, 0)')} AS second_frame, {outline('v')} FROM m
        JOIN (SELECT batch, count(*) AS n, max(embedding[1]) FILTER (i = 1) AS second,
                     sum(list_dot_product(CAST(embedding AS DOUBLE[]),
                                          CAST(embedding AS DOUBLE[]))) AS square
              FROM f GROUP BY batch) USING (batch)""",
    f="""SELECT rk // 8 AS batch, rk % 8 AS i, embedding
         FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS rk FROM embeddings)""",
    m=summed("f", "batch", "embedding", 64, "avg"),
)
sql(
    "padded_vectors",
    [],
    f"""SELECT batch, repeat('1', n) || repeat('0', 10 - n) AS mask, 10 AS padded,
           {outline("list_resize(frames, 640, 0)")}
        FROM (SELECT rk // 8 AS batch, CAST(count(*) AS INTEGER) AS n,
                     flatten(list(embedding ORDER BY rk)) AS frames
              FROM (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS rk
                    FROM embeddings) GROUP BY rk // 8)""",
)
_ZEROS = "list_transform(range({n}), lambda k: CAST(0 AS DOUBLE))"


def bag(source: str, keys: str, column: str, oov: str, v: str = "v", dims: int = 64) -> str:
    """(keys, v): sum of word vectors, zeros for an empty one."""
    join = "JOIN" if oov == "drop" else "LEFT JOIN"
    vec = f"wv.{v}" if oov == "drop" else (
        f"coalesce(wv.{v}, (SELECT {v} FROM wv WHERE word = '<unk>'))"
    )
    counted = f"""(SELECT {', '.join('t.' + k for k in keys.split(', '))}, {vec} AS v, c
        FROM (SELECT {keys}, word, count(*) AS c
              FROM (SELECT {keys}, unnest({column}) AS word FROM {source})
              GROUP BY {keys}, word) t {join} wv ON t.word = wv.word)"""
    total = f"""
        SELECT {keys}, list(s ORDER BY d) AS v FROM (
            SELECT {keys}, d, sum(x * c) AS s FROM (
                SELECT {keys}, c, unnest(CAST(v AS DOUBLE[])) AS x, unnest(range({dims})) AS d
                FROM {counted}) GROUP BY {keys}, d) GROUP BY {keys}"""
    on = " AND ".join(f"g.{k} = s.{k}" for k in keys.split(", "))
    return f"""
        SELECT {', '.join('s.' + k for k in keys.split(', '))},
               coalesce(g.v, {_ZEROS.format(n=dims)}) AS v
        FROM {source} s LEFT JOIN ({total}) g ON {on}"""


sql(
    "sentence_bow",
    ["wv"],
    f"SELECT doc_id, pos, {outline('v')} FROM b",
    b=bag("corpus", "doc_id, pos", "tokens", "drop"),
)
_TOK = "regexp_extract_all(lower(text), '" + WORD + "')"
sql(
    "encoded_texts",
    ["wv"],
    f"""SELECT doc_id, {outline('list_transform(v, lambda x: x / sqrt(q))')}
        FROM (SELECT doc_id, v, list_dot_product(v, v) AS q FROM b)""",
    t=f"SELECT doc_id, list_append({_TOK}, '<eos>') AS tokens FROM documents",
    b=bag("t", "doc_id", "tokens", "unk"),
)
sql(
    "encoded_multi",
    ["wv"],
    f"""SELECT conv_id, turn, 128 AS dim, {outline('list_concat(a.v, b.v)')}
        FROM a JOIN b USING (conv_id, turn)""",
    t=f"SELECT conv_id, turn, {_TOK} AS tokens FROM conversations",
    a=bag("t", "conv_id, turn", "tokens", "drop"),
    b=bag("t", "conv_id, turn", "tokens", "unk"),
)
sql("unit_vectors", [], f"""
    SELECT vec_id, {outline('list_transform(v, lambda x: x / sqrt(q))')}
    FROM (SELECT vec_id, v, list_dot_product(v, v) AS q
          FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))""")
sql("cosine_pairs", ["vp"], f"""
    SELECT id, {r6('list_cosine_similarity(x, y)')} AS cosine,
           {r6('list_dot_product(x, y)')} AS dot FROM vp""")


def near(source: str, v: str, k: int, own: bool) -> str:
    """(id, neighbour, similarity, rank) by brute force."""
    keep = "" if own else "AND a.id <> b.id"
    return f"""
        SELECT * FROM (
            SELECT id, neighbour, s AS similarity, CAST(row_number() OVER (
                PARTITION BY id ORDER BY s DESC, neighbour) AS INTEGER) AS rank
            FROM (SELECT a.id, b.id AS neighbour,
                         round(list_dot_product(a.{v}, b.{v})
                               / sqrt(list_dot_product(a.{v}, a.{v})
                                      * list_dot_product(b.{v}, b.{v})), 10) AS s
                  FROM {source} a, {source} b WHERE true {keep}))
        WHERE rank <= {k}"""


sql(
    "nearest",
    [],
    f"SELECT id, neighbour, rank, {r6('similarity')} AS similarity FROM n",
    e="SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    n=near("e", "v", 10, True),
)


sql(
    "nearest_of_label",
    [],
    f"""SELECT id, neighbour, rank, {r6('similarity')} AS similarity FROM n
        WHERE id IN (SELECT vec_id FROM embeddings WHERE label = 0)""",
    e="SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    n=near("e", "v", 10, True),
)


def overlap(a: str, b: str) -> str:
    return f"""(SELECT count(*) FROM embeddings) AS n, count(*) AS shared,
        {r6("count(*) / ((SELECT count(*) FROM embeddings) * 10.0)")} AS overlap
        FROM {a} JOIN {b} USING (id, neighbour)"""


sql(
    "neighbour_overlap",
    ["vp"],
    f"SELECT {overlap('nx', 'ny')}",
    nx=near("vp", "x", 10, False),
    ny=near("vp", "y", 10, False),
)


def linear(x: str, rows: int, cols: int, a: int, b: int, scale: float, bias: str) -> str:
    """Vector times the formula matrix, plus the formula bias (a Python format of j)."""
    return (
        f"list_transform(range({cols}), lambda j: {bias} + list_sum(list_transform({x}, "
        f"lambda e, i: e * sin({a} * (i - 1) + {b} * j + 1.0) / {scale})))"
    )


def linear_weights(x: str, dims: int = fx.HALF) -> str:
    return linear(x, dims, dims, 7, 13, 6.0, "sin(5 * j + 1.0) / 10.0")


def hidden_layer(x: str, hidden: int) -> str:
    inner = linear(x, 0, hidden, 7, 13, 6.0, "sin(5 * j + 1.0) / 10.0")
    return f"list_transform({inner}, lambda h: greatest(h, 0.0))"


def output_layer(h: str, outputs: int) -> str:
    return linear(h, 0, outputs, 3, 11, 4.0, "sin(2 * j + 1.0) / 10.0")


_OVERLAPS = {
    "text_image": ("nx", "ny"),
    "projected_image": ("np", "ny"),
    "text_projected": ("nx", "np"),
    "text_text": ("nx", "nx"),
}
sql(
    "overlap_report",
    ["vp"],
    " UNION ALL ".join(
        f"SELECT '{name}' AS comparison, {overlap(a, b if a != b else '(SELECT * FROM nx)')}"
        for name, (a, b) in _OVERLAPS.items()
    ),
    mapped=f"SELECT id, {linear_weights('x')} AS p FROM vp",
    nx=near("vp", "x", 10, False),
    ny=near("vp", "y", 10, False),
    np=near("mapped", "p", 10, False),
)
sql(
    "similarity_moments",
    [],
    f"""SELECT (SELECT count(*) FROM e) AS n, {r6('avg(s)')} AS mean,
           {r6('avg(s * s)')} AS mean_square
        FROM (SELECT list_cosine_similarity(a.v, b.v) AS s FROM e a, e b)""",
    e="SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
)
sql(
    "similarity_pearson",
    ["wv", "spairs"],
    f"""SELECT lang, count(*) AS n, 
               {r6('covar_pop(c, score) / nullif(stddev_pop(c) * stddev_pop(score), 0)')} AS pearson FROM (
            SELECT lang, score, coalesce(list_dot_product(a.v, b.v) / nullif(sqrt(
                list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0), 0) AS c
            FROM spairs JOIN a USING (doc_id, pos) JOIN b USING (doc_id, pos))
        GROUP BY lang""",
    t=f"SELECT doc_id, pos, {tokens('s1')} AS t1, {tokens('s2')} AS t2 FROM spairs",
    a=bag("t", "doc_id, pos", "t1", "drop"),
    b=bag("t", "doc_id, pos", "t2", "drop"),
)
sql(
    "neighbour_pairs",
    [],
    """SELECT id, neighbour, rank, a.text AS s1, b.text AS s2
       FROM n JOIN documents a ON a.doc_id = id JOIN documents b ON b.doc_id = neighbour""",
    e="""SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
         WHERE vec_id IN (SELECT doc_id FROM documents)""",
    n=near("e", "v", 3, False),
)

# --- metrics ----------------------------------------------------------------------------------

sql("batch_negatives", ["bp"], "SELECT id, batch, row, row >= size - 10 AS negative FROM bp")


def cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


def ranking(source: str) -> str:
    gap = "greatest(0, 0.5 - {p} + {n})"
    p = cos("a.x", "a.y")
    one, two = cos("b.x", "a.y"), cos("a.x", "b.y")
    return f"""
        SELECT batch, any_value(size) AS n, sum(l) / 2 / (any_value(size) - 10) AS value
        FROM (SELECT a.batch, a.size,
                     {gap.format(p=p, n=one)} + {gap.format(p=p, n=two)} AS l
              FROM {source} a JOIN {source} b ON a.batch = b.batch
              WHERE a.row < a.size - 10 AND b.row >= b.size - 10)
        GROUP BY batch"""


sql(
    "ranking_loss",
    ["bp"],
    f"SELECT batch, n, {r6('value')} AS value FROM r",
    r=ranking("bp"),
)
sql(
    "ranking_loss_projected",
    ["bp"],
    f"SELECT batch, n, {r6('value')} AS value FROM r",
    h=f"SELECT batch, row, size, y, {hidden_layer('x', 16)} AS h FROM bp",
    p=f"SELECT batch, row, size, y, {output_layer('h', fx.HALF)} AS x FROM h",
    r=ranking("p"),
)
_L2 = f"""
    SELECT batch, count(*) AS n,
           sum(list_sum(list_transform(x, lambda e, i: (e - y[i]) * (e - y[i]))))
           / (count(*) * {fx.HALF}) AS value FROM bp GROUP BY batch"""
sql("element_l2", ["bp"], f"SELECT batch, n, {r6('value')} AS value FROM l", l=_L2)
_SIMS = f"""
    SELECT a.batch, a.size, {cos('a.x', 'b.x')} AS sx, {cos('a.y', 'b.y')} AS sy
    FROM bp a JOIN bp b ON a.batch = b.batch"""
_CENTRED = """
    SELECT batch, size, sx - avg(sx) OVER (PARTITION BY batch) AS sx,
           sy - avg(sy) OVER (PARTITION BY batch) AS sy FROM sims"""
_KINDS = {"rho": "-corr(sx, sy)", "L2": "avg((sx - sy) * (sx - sy))", "L1": "avg(abs(sx - sy))"}
sql(
    "structure_alignment",
    ["bp"],
    " UNION ALL ".join(
        f"SELECT '{k}' AS kind, batch, any_value(size) AS n, {r6(v)} AS value "
        "FROM c GROUP BY batch"
        for k, v in _KINDS.items()
    ),
    sims=_SIMS,
    c=_CENTRED,
)
_MATCH = """
    SELECT a.batch, a.row, CAST(a.row = b.row AS INTEGER) AS label, a.x, b.y
    FROM bp a JOIN bp b ON a.batch = b.batch
     AND (a.row = b.row OR a.row = (b.row + b.size // 2) % b.size)"""
sql(
    "match_pairs",
    ["bp"],
    f"SELECT batch, row, label, {r6('list_dot_product(x, y)')} AS dot FROM m",
    m=_MATCH,
)
_CONTRAST = """
    SELECT batch, count(*) AS n, avg(ln(1 + exp(u - m))) AS value
    FROM (SELECT batch, row, max(list_dot_product(x, y)) FILTER (label = 1) AS m,
                 max(list_dot_product(x, y)) FILTER (label = 0) AS u
          FROM m GROUP BY batch, row) GROUP BY batch"""
sql(
    "contrast_scores",
    ["bp"],
    f"SELECT batch, n, {r6('value')} AS value FROM c",
    m=_MATCH,
    c=_CONTRAST,
)
sql(
    "match_classifier",
    ["bp"],
    f"""SELECT batch, count(*) AS n,
           {r6("avg(ln(1 + exp(CASE WHEN label = 1 THEN z[1] - z[2] ELSE z[2] - z[1] END)))")}
           AS value FROM o GROUP BY batch""",
    m=_MATCH,
    h=f"SELECT batch, label, {hidden_layer('list_concat(x, y)', 8)} AS h FROM m",
    o=f"SELECT batch, label, {output_layer('h', 2)} AS z FROM h",
)
sql(
    "projected_vectors",
    ["vp"],
    f"""SELECT id, 0 AS layers, {outline('p')}
        FROM (SELECT id, {linear_weights('x')} AS p FROM vp)
        UNION ALL SELECT id, 1, {outline('p')}
        FROM (SELECT id, {output_layer('h', fx.HALF)} AS p FROM h)""",
    h=f"SELECT id, {hidden_layer('x', 16)} AS h FROM vp",
)
_METRICS = """
    SELECT 'ranking' AS metric, avg(value) AS value FROM r
    UNION ALL SELECT 'rho', avg(value) FROM (SELECT -corr(sx, sy) AS value FROM c GROUP BY batch)
    UNION ALL SELECT 'l2', avg(value) FROM l
    UNION ALL SELECT 'quick', avg(value) FROM q"""
_METRIC_CTES = {
    "r": ranking("bp"),
    "sims": _SIMS,
    "c": _CENTRED,
    "l": _L2,
    "m": _MATCH,
    "q": _CONTRAST,
}

def _over(source: str, text: str) -> str:
    """A metric's SQL over another batch table."""
    return text.replace("FROM bp ", f"FROM {source} ").replace("JOIN bp ", f"JOIN {source} ")


sql(
    "pair_metrics_projected",
    ["bp"],
    f"SELECT metric, {r6('value')} AS value FROM ("
    + _METRICS
    + """
    UNION ALL SELECT 'ranking_f', avg(value) FROM rf
    UNION ALL SELECT 'rho_f', avg(value) FROM (SELECT -corr(sx, sy) AS value FROM simsf GROUP BY batch)
    UNION ALL SELECT 'l2_f', avg(value) FROM lf
    UNION ALL SELECT 'quick_f', avg(value) FROM qf
    UNION ALL SELECT 'ranking_both', avg(value) FROM rb)""",
    **_METRIC_CTES,
    h=f"""SELECT batch, row, size, y, {hidden_layer('x', 16)} AS h,
                 {hidden_layer('y', 16)} AS g FROM bp""",
    pj=f"""SELECT batch, row, size, y, {output_layer('h', fx.HALF)} AS x,
                  {output_layer('g', fx.HALF)} AS yp FROM h""",
    pb="SELECT batch, row, size, x, yp AS y FROM pj",
    rf=ranking("pj"),
    simsf=_over("pj", _SIMS),
    lf=_over("pj", _L2),
    mf=_over("pj", _MATCH),
    qf=_CONTRAST.replace("FROM m ", "FROM mf "),
    rb=ranking("pb"),
)
_WEIGHTED = " + ".join(
    f"{w} * max(value) FILTER (metric = '{name}')" for name, w in TOTAL_WEIGHTS.items() if w > 0
)
sql(
    "weighted_total",
    ["bp"],
    f"SELECT {r6(_WEIGHTED)} AS total FROM ({_METRICS})",
    **_METRIC_CTES,
)


def _split_metrics() -> None:
    """The metrics per split: the batch table of each split stands in for the common one."""
    parts, ctes = [], {}
    order = "md5('123:' || id), id"
    ctes["keyed"] = f"SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS k FROM vp"
    for split, cond in (("train", "k >= 160"), ("validation", "k < 160")):
        bp = f"bp_{split}"
        ctes[bp] = f"""
            SELECT *, rk // {fx.BATCH} AS batch, CAST(rk % {fx.BATCH} AS INTEGER) AS row,
                   count(*) OVER (PARTITION BY rk // {fx.BATCH}) AS size
            FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS rk
                  FROM keyed WHERE {cond})"""

        def rename(text: str) -> str:
            for old in ("bp", "sims", "m", "c", "r", "l", "q"):
                new = bp if old == "bp" else f"{old}_{split}"
                text = text.replace(f"FROM {old} ", f"FROM {new} ")
                text = text.replace(f"JOIN {old} ", f"JOIN {new} ")
                text = text.replace(f"FROM {old}\n", f"FROM {new}\n")
                if text.endswith(f"FROM {old}"):
                    text = text[: -len(old)] + new
                text = text.replace(f"FROM {old})", f"FROM {new})")
            return text

        for name, text in _METRIC_CTES.items():
            ctes[f"{name}_{split}"] = rename(text)
        parts.append(
            f"SELECT '{split}' AS split, metric, {r6('value')} AS value FROM ({rename(_METRICS)})"
        )
    sql("split_metrics", ["vp"], " UNION ALL ".join(parts), **ctes)


_split_metrics()

# --- negative sampling --------------------------------------------------------------------------

P = 2147483647
_NB = f"""
    SELECT *, rk // {NS_BATCH} AS batch, CAST(rk % {NS_BATCH} AS INTEGER) AS row
    FROM (SELECT *, row_number() OVER (ORDER BY doc_id, pos) - 1 AS rk FROM trip)"""


def mixed(source: str, item: str) -> str:
    """The rows of ``source`` with ``h``: batch, item and seed mixed to (0, 1)."""
    return f"""(
        SELECT *, ((h3 * h3 + {item} + 1) % {P} + 0.5) / {P} AS h
        FROM (SELECT *, (h2 * 48271 + batch) % {P} AS h3
          FROM (SELECT *, (h1 * h1 + {item} + 1) % {P} AS h2
            FROM (SELECT *, (batch * 7919 + {item} * 104729 + seed * 15485863) % {P} AS h1
                  FROM {source}))))"""


def drawn(seed: str, batches: str = "(SELECT DISTINCT batch FROM nb)") -> dict[str, str]:
    """d: (batch, seed, place, id), the words drawn, in order. Numbers thrown at the cumulative
    weights; if too few words were hit, the others in the order of exponential keys."""
    n = NS_K * NS_BATCH * NS_LENGTH
    return {
        "wt": """
        SELECT CAST(id AS BIGINT) AS id,
               pow((ln(id + 2) - ln(id + 1)) / ln((SELECT count(*) FROM wv) + 1), 0.75) AS w
        FROM wv""",
        "cum": """
        SELECT id, coalesce(sum(w) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING
                                         AND 1 PRECEDING), 0) AS low FROM wt""",
        "runs": f"SELECT batch, seed FROM {batches}, (SELECT CAST(unnest({seed}) AS BIGINT) AS seed)",
        "thrown": f"""
        SELECT batch, seed, attempt, h * (SELECT sum(w) FROM wt) AS mark
        FROM {mixed(f"runs, (SELECT unnest(range({TRIES * n})) AS attempt)", "attempt")}""",
        "firsts": f"""
        SELECT *, row_number() OVER (PARTITION BY batch, seed ORDER BY attempt) - 1 AS place
        FROM (SELECT batch, seed, id, min(attempt) AS attempt
              FROM thrown ASOF JOIN cum ON mark >= low GROUP BY batch, seed, id)""",
        "short": f"""
        SELECT batch, seed, count(*) AS had FROM firsts GROUP BY batch, seed
        HAVING count(*) < {n}""",
        "d": f"""
        SELECT batch, seed, place, id FROM firsts WHERE place < {n}
        UNION ALL
        SELECT batch, seed, had + row_number() OVER (
                   PARTITION BY batch, seed ORDER BY -ln(h) / w, id) - 1 AS place, id
        FROM {mixed("short, wt", "id")} l WHERE NOT EXISTS (
            SELECT 1 FROM firsts f WHERE f.batch = l.batch AND f.seed = l.seed AND f.id = l.id)
        QUALIFY place < {n}""",
    }


sql(
    "sample_negatives",
    ["wv", "trip"],
    f"""SELECT batch, place // {NS_K} AS position, CAST(place % {NS_K} AS INTEGER) AS slot,
           CAST(id AS INTEGER) AS id FROM d""",
    nb=_NB,
    **drawn("[123]"),
)
_POSITIVE = " UNION ALL ".join(
    f"""SELECT batch, row, '{part}' AS part, {seed} AS seed, t, id, v FROM (
            SELECT batch, row, w.id, w.v, row_number() OVER (
                PARTITION BY batch, row ORDER BY i) - 1 AS t
            FROM (SELECT batch, row, unnest({col}) AS word, unnest(range(len({col}))) AS i
                  FROM nb) u JOIN wv w ON u.word = w.word)"""
    for part, col, seed in (
        ("pre", "decode_pre", 123), ("post", "decode_post", 124), ("own", "encode", 125)
    )
)
sql(
    "positive_pairs",
    ["wv", "trip"],
    "SELECT batch, row, part, CAST(t AS INTEGER) AS t, id FROM p",
    nb=_NB,
    p=_POSITIVE,
)
sql(
    "negative_sampling_loss",
    ["wv", "trip"],
    f"""SELECT batch, {r6(f'coalesce(sum(l), 0) / ({NS_BATCH} * {NS_LENGTH})')} AS value
        FROM (SELECT DISTINCT batch FROM nb) LEFT JOIN (
            SELECT p.batch, ln(1 + exp(-list_dot_product(s.v, tp.o)))
                            + ln(1 + exp(list_dot_product(s.v, tn.o))) AS l
            FROM p JOIN sv s ON p.batch = s.batch AND p.row = s.row
            JOIN d ON d.batch = p.batch AND d.seed = p.seed
                  AND d.place = p.row * {NS_LENGTH} + p.t
            JOIN tv tp ON tp.id = p.id JOIN tv tn ON tn.id = d.id) USING (batch)
        GROUP BY batch""",
    nb=_NB,
    p=_POSITIVE,
    **drawn("[123, 124, 125]"),
    tv=f"""SELECT id, CAST(v[{fx.HALF + 1}:{2 * fx.HALF}] AS DOUBLE[]) AS o FROM wv""",
    whole=bag("nb", "batch, row", "encode", "drop"),
    sv=f"SELECT batch, row, v[1:{fx.HALF}] AS v FROM whole",
)

# --- vocabulary expansion -------------------------------------------------------------------------

_LARGE = "SELECT word, id, CAST(v[1:16] AS DOUBLE[]) AS x FROM wv"
_OWN = """SELECT word, id, CAST(v[17:32] AS DOUBLE[]) AS y FROM wv
          WHERE word IN (SELECT unnest(tokens) FROM turns)"""
_MAPPED = f"""SELECT word, id, {linear('x', 16, 16, 7, 13, 6.0, 'sin(5 * j + 1.0) / 10.0')} AS m
              FROM large WHERE NOT contains(word, '_')"""
sql(
    "space_map_gram",
    ["wv", "turns"],
    f"""SELECT 'n' AS kind, 0 AS i, 0 AS j, {r6('count(*)')} AS value FROM s
        UNION ALL SELECT 'x', CAST(i AS INTEGER), 0, {r6('sum(x[i + 1])')}
            FROM s, range(16) t(i) GROUP BY i
        UNION ALL SELECT 'y', CAST(i AS INTEGER), 0, {r6('sum(y[i + 1])')}
            FROM s, range(16) t(i) GROUP BY i
        UNION ALL SELECT 'xx', CAST(i AS INTEGER), CAST(j AS INTEGER),
            {r6('sum(x[i + 1] * x[j + 1])')} FROM s, range(16) t(i), range(16) u(j) GROUP BY i, j
        UNION ALL SELECT 'xy', CAST(i AS INTEGER), CAST(j AS INTEGER),
            {r6('sum(x[i + 1] * y[j + 1])')} FROM s, range(16) t(i), range(16) u(j)
            GROUP BY i, j""",
    large=_LARGE,
    own=_OWN,
    s="SELECT word, x, y FROM large JOIN own USING (word)",
)
sql(
    "space_map_residuals",
    [],
    """SELECT 'y' AS kind, CAST(i AS INTEGER) AS i, 0 AS j, 0.0::DOUBLE AS value FROM range(16) t(i)
       UNION ALL SELECT 'xy', CAST(i AS INTEGER), CAST(j AS INTEGER), 0.0::DOUBLE FROM range(16) t(i), range(16) u(j)""",
)
sql(
    "space_map_applied",
    ["wv"],
    f"SELECT word, id, {outline('m')} FROM mapped",
    large=_LARGE,
    mapped=_MAPPED,
)
sql(
    "expand_vocab",
    ["wv", "turns"],
    f"""SELECT row_number() OVER (ORDER BY fresh, place) - 1 AS pos, word, {outline('v')} FROM (
            SELECT word, coalesce(o.y, g.m) AS v, g.id IS NULL AS fresh,
                   coalesce(g.id, o.id) AS place
            FROM mapped g FULL JOIN own o USING (word))""",
    large=_LARGE,
    own=_OWN,
    mapped=_MAPPED,
)

# The fit: normal equations of (1, x), eliminated column by column.
sql(
    "expand_vocab_fitted",
    ["wv", "turns"],
    f"""SELECT row_number() OVER (ORDER BY fresh, place) - 1 AS pos, word, {outline('v')} FROM (
            SELECT word, coalesce(o.y, g.m) AS v, g.id IS NULL AS fresh,
                   coalesce(g.id, o.id) AS place
            FROM mapped g FULL JOIN own o USING (word))""",
    large=_LARGE,
    own=_OWN,
    s="SELECT list_concat([1.0::DOUBLE], x) AS p, list_concat([1.0::DOUBLE], x, y) AS q FROM large JOIN own USING (word)",
    cells="SELECT i, j, sum(p[i + 1] * q[j + 1]) AS c FROM s, range(17) t(i), range(33) u(j) GROUP BY i, j",
    lines="SELECT i, list(c ORDER BY j) AS r FROM cells GROUP BY i",
    solved="""
        SELECT 0 AS k, list(r ORDER BY i) AS m FROM lines
        UNION ALL
        SELECT k + 1, list_transform(m, lambda r, i: list_transform(r, lambda v, j:
            CASE WHEN i = k + 1 THEN v / p[k + 1] ELSE v - r[k + 1] * p[j] / p[k + 1] END))
        FROM (SELECT k, m, m[k + 1] AS p FROM solved WHERE k < 17)""",
    mapped="""
        SELECT word, id, list_transform(range(18, 34), lambda j:
            f[1][j] + list_sum(list_transform(x, lambda v, i: v * f[i + 1][j]))) AS m
        FROM large, (SELECT m AS f FROM solved WHERE k = 17) WHERE NOT contains(word, '_')""",
)
ORACLES["expand_vocab_fitted"] = ORACLES["expand_vocab_fitted"].replace("WITH ", "WITH RECURSIVE ", 1).replace("solved AS MATERIALIZED (", "solved AS (")

# --- recurrent encoder ------------------------------------------------------------------------------


def wave_columns(rows: int, cols: int, a: str, b: int) -> str:
    """The columns of a formula matrix, as a list of lists."""
    return f"list_transform(range({cols}), lambda j: list_transform(range({rows}), lambda i: sin({a} * i + {b} * j + 1.0) / 3.0))"


def times(v: str, columns: str) -> str:
    return f"list_transform({columns}, lambda c: list_dot_product({v}, c))"


def spread(v: str, mean: str) -> str:
    return f"sqrt(list_avg(list_transform({v}, lambda x: (x - {mean}) * (x - {mean}))) + 1e-12)"


sql(
    "sentence_gru",
    ["wv", "turns"],
    f"""SELECT conv_id, turn, {outline('v')} FROM (
            SELECT a.conv_id, a.turn, list_concat(a.h, b.h) AS v
            FROM (SELECT * FROM g WHERE dir = 1 AND i = n) a
            JOIN (SELECT * FROM g WHERE dir = 2 AND i = n) b ON a.conv_id = b.conv_id AND a.turn = b.turn)""",
    k=f"""
        SELECT dir, {wave_columns(16, 32, '(3 + dir)', 5)} AS wh, {wave_columns(64, 32, '(7 + dir)', 11)} AS wx,
               {wave_columns(16, 16, '(2 + dir)', 9)} AS u, {wave_columns(64, 16, '(4 + dir)', 3)} AS w
        FROM (SELECT unnest([1, 2]) AS dir)""",
    lin=f"""
        SELECT word, dir, {times('x', 'wx')} AS g, {times('x', 'w')} AS c
        FROM (SELECT word, CAST(v AS DOUBLE[]) AS x FROM wv), k""",
    centred="SELECT *, list_avg(g) AS gm, list_avg(c) AS cm FROM lin",
    pre=f"""
        SELECT word, dir, list_transform(g, lambda x: (x - gm) / gs) AS gx, list_transform(c, lambda x: (x - cm) / cs) AS cx
        FROM (SELECT *, {spread('g', 'gm')} AS gs, {spread('c', 'cm')} AS cs FROM centred)""",
    seq="""
        SELECT conv_id, turn, dir, i, coalesce(a.gx, b.gx) AS gx, coalesce(a.cx, b.cx) AS cx
        FROM (SELECT conv_id, turn, dir, unnest(CASE dir WHEN 1 THEN tokens ELSE list_reverse(tokens) END) AS word,
                     unnest(range(len(tokens))) AS i FROM turns, (SELECT unnest([1, 2]) AS dir)) s
        LEFT JOIN pre a USING (word, dir) JOIN pre b ON b.word = '<unk>' AND b.dir = s.dir""",
    g=f"""
        SELECT conv_id, turn, dir, len(tokens) AS n, 0::BIGINT AS i, list_resize([]::DOUBLE[], 16, 0.0::DOUBLE) AS h
        FROM turns, (SELECT unnest([1, 2]) AS dir)
        UNION ALL
        SELECT conv_id, turn, dir, n, i + 1, list_transform(range(1, 17), lambda j: h[j] + z[j] * (tanh(z[16 + j] * (q[j] - qm) / qs + cx[j]) - h[j]))
        FROM (SELECT *, list_transform(range(1, 33), lambda j: 1 / (1 + exp(-((s[j] - sm) / ss + gx[j])))) AS z
          FROM (SELECT *, {spread('s', 'sm')} AS ss, {spread('q', 'qm')} AS qs
            FROM (SELECT *, list_avg(s) AS sm, list_avg(q) AS qm
              FROM (SELECT g.*, gx, cx, {times('h', 'wh')} AS s, {times('h', 'u')} AS q
                FROM g JOIN seq USING (conv_id, turn, dir, i) JOIN k USING (dir)))))""",
)
ORACLES["sentence_gru"] = ORACLES["sentence_gru"].replace("WITH ", "WITH RECURSIVE ", 1).replace("g AS MATERIALIZED (", "g AS (")

# The same results by the join of a vocabulary over the broadcast limit, or from a stored table.
for _joined, _twin in [
    ("encode_ids_joined", "encode_ids_drop"),
    ("word_vectors_joined", "word_vectors"),
    ("bow_joined", "sentence_bow"),
    ("stored_expansion", "expand_vocab"),
    ("nearest_indexed", "nearest"),
    ("stored_set", "stored_records"),
    ("vocabulary_summaries", "vocabulary"),
    ("captions_bucketed", "captions_features"),
    ("negative_sampling_loss_joined", "negative_sampling_loss"),
    ("corpus_job_stats", "corpus_stats"),
    ("caption_job_stats", "caption_stats"),
]:
    ORACLES[_joined] = ORACLES[_twin]
