"""DuckDB SQL oracles, one per registered query, over the driver's pre-registered views.

They are written from the definitions (Python ``str.strip``, dict overwrite, the 13a rules,
the BLEU formula), not from the Spark code, and model the TMX corpus of
:mod:`tunedata.plans.corpus` straight from the tables: the Spark side has to build,
encode, parse and pair the XML to agree with them.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+$', '', 'g')"


# ---------------------------------------------------------------- TMX corpus as plain rows

UNITS = """
cp AS (
  SELECT u.conv_id, u.turn, u.text AS src, a.text AS tgt
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
),
cu AS (
  SELECT 'conv/' || CAST(conv_id // 8 AS VARCHAR) || '/' || CAST(turn // 64 AS VARCHAR) || '.tmx' AS path,
         conv_id AS o1, turn AS o2, src, tgt,
         ['IT-IT', 'FR-FR', 'DE-DE', 'ES-ES', 'GA-IE'][CAST(conv_id % 5 AS INTEGER) + 1] AS lang,
         CAST((conv_id + turn) % 10 AS INTEGER) AS k,
         (conv_id * 7 + turn) % 13 = 0 AS bad
  FROM cp
),
pu AS (
  SELECT 'pages/' || CAST(page_id // 8 AS VARCHAR) || '.tmx' AS path, page_id AS o1, CAST(0 AS BIGINT) AS o2,
         html AS src, url AS tgt, 'IT-IT' AS lang, -1 AS k, false AS bad
  FROM pages
),
units AS (
  -- each unit of variant 9 follows an empty unit, which has a position and no segments
  SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY o1, o2) - 1
                 + count(*) FILTER (k = 9 AND NOT bad) OVER (PARTITION BY path ORDER BY o1, o2) AS INTEGER) AS tu_idx
  FROM (SELECT * FROM cu UNION ALL SELECT * FROM pu)
),
seglists AS (
  SELECT path, tu_idx, CASE
    WHEN k IN (-1, 0, 5) THEN [{'lang': 'EN-GB', 'raw': src}, {'lang': lang, 'raw': tgt}]
    WHEN k = 1 THEN [{'lang': 'EN-GB', 'raw': src}, {'lang': lang, 'raw': tgt}, {'lang': 'MT-MT', 'raw': tgt || ' (mt) </tu>'}]
    WHEN k = 2 THEN [{'lang': 'EN-GB', 'raw': src}, {'lang': lang, 'raw': '  '}]
    WHEN k IN (3, 6) THEN [{'lang': 'EN-GB', 'raw': src}, {'lang': lang, 'raw': ''}]
    WHEN k = 4 THEN [{'lang': 'EN-GB', 'raw': src}, {'lang': lang, 'raw': 'draft'}, {'lang': lang, 'raw': tgt}]
    WHEN k = 7 THEN [{'lang': 'en-gb', 'raw': src}, {'lang': lang, 'raw': tgt}]
    WHEN k = 8 THEN [{'lang': NULL::VARCHAR, 'raw': NULL::VARCHAR}, {'lang': 'EN-GB', 'raw': src},
                     {'lang': NULL::VARCHAR, 'raw': 'x'}, {'lang': lang, 'raw': tgt}]
    ELSE [{'lang': 'EN-GB', 'raw': '  ' || src || chr(8195)}, {'lang': lang, 'raw': chr(9) || tgt || ' ' || chr(10)}]
  END AS l
  FROM units WHERE NOT bad
),
segrows AS (
  SELECT path, tu_idx, CAST(tuv_idx AS INTEGER) AS tuv_idx, s.lang AS lang, s.raw AS raw
  FROM (SELECT path, tu_idx, generate_subscripts(l, 1) - 1 AS tuv_idx, unnest(l) AS s FROM seglists)
)"""


def pairs_cte(policy: str, max_tus: int | None = None) -> str:
    keep_raw = "raw IS NOT NULL" + (" AND raw <> ''" if policy == "validation" else "")
    cap = f" AND tu_idx < {max_tus}" if max_tus is not None else ""
    keep_tgt = " AND d.seg <> ''" if policy == "training" else ""
    return f"""
v AS (SELECT path, tu_idx, tuv_idx, lang, {strip('raw')} AS seg FROM segrows
      WHERE lang IS NOT NULL AND lang <> '' AND {keep_raw}{cap}),
d AS (SELECT path, tu_idx, lang, arg_max(seg, tuv_idx) AS seg, min(tuv_idx) AS lang_pos FROM v GROUP BY path, tu_idx, lang),
s AS (SELECT path, tu_idx, seg AS src FROM d WHERE lang = 'EN-GB'),
pairs AS (
  SELECT d.path, d.tu_idx, CAST(d.lang_pos AS INTEGER) AS lang_pos, s.src, d.seg AS tgt, d.lang
  FROM d JOIN s ON d.path = s.path AND d.tu_idx = s.tu_idx
  WHERE s.src <> '' AND d.lang <> 'EN-GB'{keep_tgt}
)"""


def with_units(*ctes: str) -> str:
    return "WITH " + ",\n".join((UNITS,) + ctes)


PROMPT = "'Translate the following English text to ' || {label} || ': ''' || src || ''''"
LABEL = "upper(split_part(lang, '-', 1))"

ORACLES["tmx_segments"] = with_units() + f"\nSELECT path, tu_idx, tuv_idx, lang, {strip('raw')} AS seg FROM segrows"
ORACLES["tmx_pairs_training"] = with_units(pairs_cte("training")) + "\nSELECT * FROM pairs"
ORACLES["tmx_pairs_validation"] = with_units(pairs_cte("validation")) + "\nSELECT * FROM pairs"
ORACLES["tmx_first_units"] = with_units(pairs_cte("validation", 20)) + "\nSELECT * FROM pairs"
ORACLES["tmx_quarantine"] = with_units() + "\nSELECT path, CAST(count(*) AS BIGINT) AS n_bad FROM units WHERE bad GROUP BY path"
ORACLES["tmx_pairs_skip_file"] = (
    with_units(pairs_cte("validation"))
    + "\nSELECT * FROM pairs WHERE path NOT IN (SELECT path FROM units WHERE bad)"
)
ORACLES["sft_examples"] = with_units(pairs_cte("training")) + (
    f"\nSELECT path, tu_idx, lang_pos, {PROMPT.format(label=LABEL)} AS prompt, tgt AS completion FROM pairs"
)
ORACLES["flat_text"] = with_units(pairs_cte("training")) + (
    f"\nSELECT path, tu_idx, lang_pos, {PROMPT.format(label=LABEL)} || ' Output: ' || tgt AS text FROM pairs"
)
ORACLES["drop_blank"] = with_units(pairs_cte("validation")) + (
    f"\nSELECT path, tu_idx, lang_pos, {PROMPT.format(label=LABEL)} AS prompt, tgt AS completion FROM pairs"
    f"\nWHERE {strip('tgt')} <> ''"
)
ORACLES["lang_codes"] = with_units(pairs_cte("validation")) + (
    "\nSELECT path, tu_idx, lang_pos, src, tgt, substr(upper(coalesce(lang, '')), 1, 2) AS lang FROM pairs"
)
LANG_NAMES_VALUES = """names(code, name) AS (VALUES ('BG','Bulgarian'), ('CS','Czech'), ('DA','Danish'), ('DE','German'),
  ('EL','Greek'), ('EN','English'), ('ES','Spanish'), ('ET','Estonian'), ('FI','Finnish'), ('FR','French'), ('GA','Irish'),
  ('HR','Croatian'), ('HU','Hungarian'), ('IT','Italian'), ('LT','Lithuanian'), ('LV','Latvian'), ('MT','Maltese'),
  ('NL','Dutch'), ('PL','Polish'), ('PT','Portuguese'), ('RO','Romanian'), ('SK','Slovak'), ('SL','Slovenian'), ('SV','Swedish'))"""
ORACLES["lang_names"] = with_units(pairs_cte("training"), LANG_NAMES_VALUES) + (
    f"\nSELECT path, tu_idx, lang_pos, {PROMPT.format(label='coalesce(n.name, ' + LABEL + ')')} AS prompt, tgt AS completion"
    f"\nFROM pairs LEFT JOIN names n ON n.code = {LABEL}"
)

# ---------------------------------------------------------------- sources / sinks / counters

SFT_SQL = f"SELECT path, tu_idx, lang_pos, {PROMPT.format(label=LABEL)} AS prompt, tgt AS completion FROM pairs"
ORACLES["jsonl_roundtrip"] = with_units(pairs_cte("training")) + "\n" + SFT_SQL
ORACLES["jsonl_ascii"] = with_units(pairs_cte("training")) + f"\nSELECT *, true AS is_ascii FROM ({SFT_SQL})"
ORACLES["lang_codes_mixed_fields"] = """SELECT doc_id, upper(substr(coalesce(lang || '-xx', ''), 1, 2)) AS lang,
  CASE doc_id % 3 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN '{"n":' || n_chars || ',"to":null}' ELSE '[' || n_chars || ',"x"]' END AS meta
FROM documents"""
ORACLES["preview_examples"] = with_units(pairs_cte("training")) + f"""
SELECT CAST(row_number() OVER (ORDER BY path, tu_idx, lang_pos) AS INTEGER) AS example_no, prompt, completion
FROM ({SFT_SQL}) ORDER BY path, tu_idx, lang_pos LIMIT 5"""
ORACLES["dataset_stats"] = with_units(pairs_cte("training")) + """
SELECT lang, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT (path, tu_idx)) AS BIGINT) AS n_units,
       CAST(count(DISTINCT path) AS BIGINT) AS n_files
FROM pairs GROUP BY lang"""

# ---------------------------------------------------------------- splits


def hash_rank(key: str, table: str, seed: int) -> str:
    return (
        f"SELECT {key}, CAST(row_number() OVER (ORDER BY md5('{seed}|' || CAST({key} AS VARCHAR)), {key}) AS BIGINT) AS shuffle_pos,"
        f" count(*) OVER () AS n FROM {table}"
    )


ORACLES["split_random"] = f"""WITH r AS ({hash_rank('o_orderkey', 'orders', 42)})
SELECT o_orderkey, shuffle_pos, CASE WHEN shuffle_pos <= floor(CAST(0.8 AS DOUBLE) * n) THEN 'train' ELSE 'valid' END AS split FROM r"""
ORACLES["split_test_size"] = f"""WITH r AS ({hash_rank('doc_id', 'documents', 42)})
SELECT doc_id, shuffle_pos, CASE WHEN shuffle_pos <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM r"""
ORACLES["split_head_tail"] = """WITH r AS (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS pos, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, pos, CASE WHEN pos <= floor(CAST(0.8 AS DOUBLE) * n) THEN 'train' ELSE 'valid' END AS split FROM r"""
ORACLES["split_pairs_head_tail"] = with_units(pairs_cte("training")) + """,
r AS (SELECT path, tu_idx, lang_pos, CAST(row_number() OVER (ORDER BY path, tu_idx, lang_pos) AS BIGINT) AS pos, count(*) OVER () AS n FROM pairs)
SELECT path, tu_idx, lang_pos, pos, CASE WHEN pos <= floor(CAST(0.8 AS DOUBLE) * n) THEN 'train' ELSE 'valid' END AS split FROM r"""
ORACLES["shuffle_positions"] = f"SELECT doc_id, shuffle_pos FROM ({hash_rank('doc_id', 'documents', 7)})"
ORACLES["split_complement"] = """SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(count(*) AS BIGINT) AS n_parts,
  CAST(0 AS BIGINT) AS n_overlap, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_extra FROM orders"""

# ---------------------------------------------------------------- SFT tokenisation

TOKEN_RE = r"</?s>|\[/?INST\]|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
KEYS = "path, tu_idx, lang_pos"
CHAT = f"""sft AS ({SFT_SQL}),
chat AS (SELECT {KEYS}, prompt, completion, '<s>[INST] ' || prompt || ' [/INST]' AS user_text,
         '<s>[INST] ' || prompt || ' [/INST] ' || completion || '</s>' AS full_text FROM sft)"""


def vocab_cte(source: str, col: str, max_size: int) -> str:
    return f"""toks AS (SELECT unnest(regexp_extract_all({col}, '{TOKEN_RE}')) AS token FROM {source}),
cnt AS (SELECT token, count(*) AS freq FROM toks WHERE token NOT IN ('<unk>', '<s>', '</s>') GROUP BY token),
top AS (SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token) + 2 AS INTEGER) AS id, CAST(freq AS BIGINT) AS freq
        FROM cnt QUALIFY row_number() OVER (ORDER BY freq DESC, token) <= {max_size - 3}),
vocab AS (SELECT token, id, freq FROM top
          UNION ALL SELECT * FROM (VALUES ('<unk>', 0, CAST(0 AS BIGINT)), ('<s>', 1, CAST(0 AS BIGINT)), ('</s>', 2, CAST(0 AS BIGINT))) v(token, id, freq))"""


def enc_cte(name: str, source: str, keys: str, col: str, bos: bool) -> str:
    """ids of a text column: tokens by position, looked up in ``vocab`` (unknown → 0), BOS first."""
    head = "[1] || " if bos else ""
    return f"""{name}_t AS (SELECT {keys}, unnest(regexp_extract_all({col}, '{TOKEN_RE}')) AS tok,
                   generate_subscripts(regexp_extract_all({col}, '{TOKEN_RE}'), 1) AS pos FROM {source}),
{name} AS (SELECT s.*, {head}coalesce(e.ids, []) AS ids FROM (SELECT {keys} FROM {source}) s LEFT JOIN
  (SELECT {keys}, list(coalesce(v.id, 0) ORDER BY pos) AS ids FROM {name}_t LEFT JOIN vocab v ON v.token = tok GROUP BY {keys}) e
  USING ({keys}))"""


def padded(ids: str, length: int, value: int = 2) -> str:
    return f"list_concat({ids}[1:{length}], list_transform(range({length} - least(len({ids}), {length})), lambda x: {value}))"


def att(ids: str, length: int) -> str:
    return (f"list_concat(list_transform(range(least(len({ids}), {length})), lambda x: 1),"
            f" list_transform(range({length} - least(len({ids}), {length})), lambda x: 0))")


def j(x: str) -> str:
    return f"array_to_string({x}, ' ')"


ORACLES["chat_template"] = with_units(pairs_cte("training"), CHAT) + f"\nSELECT {KEYS}, user_text, full_text FROM chat"
ORACLES["infer_prompts"] = with_units(pairs_cte("validation")) + f"""
SELECT {KEYS}, '<s>[INST] Translate the following English text to ' || substr(upper(lang), 1, 2) || ': ''' || src || ''' [/INST]' AS quoted,
       '<s>[INST] Translate to ' || substr(upper(lang), 1, 2) || ':' || chr(10) || src || ' [/INST]' AS legacy
FROM pairs"""
ORACLES["vocab"] = "WITH " + vocab_cte("documents", "text", 5000) + "\nSELECT token, id, freq FROM vocab"
ORACLES["encode"] = "WITH " + vocab_cte("documents", "text", 5000) + ",\n" + enc_cte("e", "documents", "doc_id", "text", True) + (
    f"\nSELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids, {j('ids')} AS ids FROM e"
)
ORACLES["pad_mask"] = "WITH " + vocab_cte("documents", "text", 5000) + ",\n" + enc_cte("e", "documents", "doc_id", "text", True) + (
    f"\nSELECT doc_id, {j(padded('ids', 256))} AS input_ids, {j(att('ids', 256))} AS attention_mask FROM e"
)


def label_sql(mode: str) -> str:
    ctes = [pairs_cte("training"), CHAT, vocab_cte("chat", "full_text", 2000)]
    if mode in ("prompt_masked", "prompt_masked_bos", "collated", "intended"):
        L = 256
        ctes.append(enc_cte("ef", "chat", KEYS, "full_text", True))
        ctes.append(enc_cte("eu", "chat", KEYS, "user_text", mode in ("prompt_masked_bos", "intended")))
        ctes.append(f"""b AS (SELECT {KEYS}, {padded('ef.ids', L)} AS input_ids, {att('ef.ids', L)} AS attention_mask,
                      least(len(eu.ids), {L}) AS u FROM ef JOIN eu USING ({KEYS}))""")
        if mode == "collated":
            lab = "list_transform(input_ids, lambda x: CASE WHEN x = 2 THEN -100 ELSE x END)"
        elif mode == "intended":
            lab = "list_transform(input_ids, lambda x, i: CASE WHEN i <= u OR attention_mask[i] = 0 THEN -100 ELSE x END)"
        else:
            lab = "list_transform(input_ids, lambda x, i: CASE WHEN i <= u THEN -100 ELSE x END)"
        return with_units(*ctes) + f"\nSELECT {KEYS}, {j('input_ids')} AS input_ids, {j('attention_mask')} AS attention_mask, {j(lab)} AS labels FROM b"
    L = 128
    ctes.append(enc_cte("ep", "chat", KEYS, "prompt", True))
    ctes.append(enc_cte("ec", "chat", KEYS, "completion", True))
    if mode == "seq2seq":
        lab = f"list_transform({padded('ec.ids', L)}, lambda x: CASE WHEN x = 2 THEN -100 ELSE x END)"
        return with_units(*ctes) + (
            f"\nSELECT {KEYS}, {j(padded('ep.ids', L))} AS input_ids, {j(att('ep.ids', L))} AS attention_mask, {j(lab)} AS labels"
            f"\nFROM ep JOIN ec USING ({KEYS})"
        )
    # seq2seq_pad100: an empty text encodes as [pad]
    pi = "CASE WHEN coalesce(c.prompt, '') = '' THEN [2] ELSE ep.ids END"
    ci = "CASE WHEN coalesce(c.completion, '') = '' THEN [2] ELSE ec.ids END"
    return with_units(*ctes) + (
        f"\nSELECT {', '.join('c.' + k for k in KEYS.split(', '))}, {j(padded(pi, L))} AS input_ids, {j(padded(ci, L, -100))} AS labels"
        f"\nFROM chat c JOIN ep USING ({KEYS}) JOIN ec USING ({KEYS})"
    )


for _m in ("prompt_masked", "prompt_masked_bos", "collated", "intended", "seq2seq", "seq2seq_pad100"):
    ORACLES[f"labels_{_m}"] = label_sql(_m)

ORACLES["token_validation"] = with_units(pairs_cte("training")) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_bad_length FROM pairs"""
_intended = label_sql("intended")
ORACLES["training_table"] = _intended.replace(
    f"\nSELECT {KEYS}, {j('input_ids')} AS input_ids",
    f"\nSELECT {KEYS}, CASE WHEN row_number() OVER (ORDER BY {KEYS}) <= floor(CAST(0.8 AS DOUBLE) * count(*) OVER ()) THEN 'train' ELSE 'valid' END AS split,"
    f" {j('input_ids')} AS input_ids",
)
ORACLES["minibatches"] = with_units(pairs_cte("training")) + f""",
r AS (SELECT {KEYS}, row_number() OVER (ORDER BY {KEYS}) AS pos, count(*) OVER () AS n FROM pairs)
SELECT {KEYS}, CAST((pos - 1) // 8 AS BIGINT) AS batch_id, CAST((pos - 1) // 8 // 4 AS BIGINT) AS step_id
FROM r WHERE (pos - 1) // 8 < n // 8"""

ORACLES["epoch_batches"] = with_units(pairs_cte("training")).replace("WITH", "WITH RECURSIVE", 1) + f""",
r AS (SELECT {KEYS}, row_number() OVER (ORDER BY {KEYS}) - 1 AS x, count(*) OVER () AS n FROM pairs),
h AS (SELECT CAST(e.range AS INTEGER) AS epoch, CAST(i.range AS INTEGER) AS i, md5('42|' || e.range || '|' || i.range) AS h FROM range(3) e, range(128) i),
c AS (SELECT epoch, i, CAST('0x' || substr(h, 1, 15) AS BIGINT) AS k, CAST('0x' || substr(h, 16, 7) AS BIGINT) AS a,
             CAST('0x' || substr(h, 23, 7) AS BIGINT) AS b FROM h),
w AS (SELECT {KEYS}, n, epoch, CAST(0 AS INTEGER) AS i, CAST(x AS BIGINT) AS x FROM r, (SELECT DISTINCT epoch FROM c)
      UNION ALL
      SELECT {KEYS}, n, w.epoch, w.i + 1, CASE WHEN ((greatest(x, (k % n + n - x) % n) % 2147483647) * (a + 1) + b) % 2147483647 < 1073741823
             THEN (k % n + n - x) % n ELSE x END FROM w JOIN c ON c.epoch = w.epoch AND c.i = w.i)
SELECT {KEYS}, epoch, x AS epoch_pos, CAST(x // 8 AS BIGINT) AS batch_id FROM w WHERE i = 128 AND x // 8 < n // 8"""
ORACLES["batches_from_index"] = with_units(pairs_cte("training")) + f""",
r AS (SELECT *, row_number() OVER (ORDER BY {KEYS}) - 1 AS pos, count(*) OVER () AS n FROM ({SFT_SQL}))
SELECT {KEYS}, prompt, completion, CAST(pos // 8 AS BIGINT) AS batch_id FROM r WHERE pos // 8 BETWEEN 20 AND n // 8 - 1"""

# ---------------------------------------------------------------- inference

def words(x: str) -> str:
    """Python ``str.split()``."""
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


EVAL = pairs_cte("validation") + """,
preds AS (
  SELECT s.system, p.path, p.tu_idx, p.lang_pos, substr(upper(coalesce(p.lang, '')), 1, 2) AS lang, p.src, p.tgt,
    CASE s.system WHEN 'echo' THEN """ + strip("p.src") + """
      WHEN 'half' THEN array_to_string(""" + words("p.tgt") + "[1:len(" + words("p.tgt") + """) // 2], ' ')
      ELSE array_to_string(list_reverse(""" + words("p.tgt") + """), ' ') END AS prediction
  FROM pairs p, (VALUES ('echo'), ('half'), ('reversed')) s(system)
)"""

ORACLES["reply_extract"] = "WITH " + UNITS.split("cu AS")[0].rstrip().rstrip(",") + f"""
SELECT conv_id, turn, {strip("string_split('<s>[INST] ' || src || CASE WHEN turn % 3 = 0 THEN ' [/INST] draft [/INST] ' ELSE ' [/INST] ' END || tgt, '[/INST]')[-1]")} AS reply
FROM cp"""
ORACLES["predictions_by_system"] = with_units(EVAL) + f"\nSELECT system, {KEYS}, lang, prediction FROM preds"
ORACLES["predictions_resumed"] = with_units(EVAL) + f"\nSELECT {KEYS}, lang, prediction FROM preds WHERE system = 'reversed'"
ORACLES["prediction_diff"] = with_units(EVAL) + f"""
SELECT a.lang, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE a.prediction IS DISTINCT FROM b.prediction) AS BIGINT) AS n_diff
FROM preds a JOIN preds b USING ({KEYS}) WHERE a.system = 'echo' AND b.system = 'half' GROUP BY a.lang"""
ORACLES["max_abs_delta"] = """
SELECT a.vec_id, round(list_max(list_transform(list_zip(a.embedding, b.embedding),
       lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 6) AS max_abs_delta
FROM embeddings a JOIN embeddings b ON b.vec_id - 1 = a.vec_id"""

# ---------------------------------------------------------------- metrics


def tok13a(x: str) -> str:
    t = rstrip(f"coalesce({x}, '')")
    t = f"replace(replace(replace({t}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    t = f"replace(replace(replace(replace({t}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    t = f"(' ' || {t} || ' ')"
    t = f"regexp_replace({t}, '([\\{{-~\\[-` -&\\(-\\+:-@/])', ' \\1 ', 'g')"
    t = f"regexp_replace({t}, '([^0-9])([\\.,])', '\\1 \\2 ', 'g')"
    t = f"regexp_replace({t}, '([\\.,])([^0-9])', ' \\1 \\2', 'g')"
    t = f"regexp_replace({t}, '([0-9])(-)', '\\1 \\2 ', 'g')"
    return words(t)


def ngr(t: str, n: int) -> str:
    return f"list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))"


SEG_KEY = f"system, {KEYS}"


def stats_cte(refs: list[str], group: str) -> str:
    """Per-segment BLEU statistics ``st`` over ``preds`` with the given reference expressions."""
    ref_cols = ", ".join(f"{tok13a(r)} AS r{i}" for i, r in enumerate(refs))
    hg = " UNION ALL ".join(f"SELECT {SEG_KEY}, {n} AS n, unnest({ngr('h', n)}) AS gram FROM seg" for n in range(1, 5))
    rg = " UNION ALL ".join(
        f"SELECT {SEG_KEY}, {i} AS ri, {n} AS n, unnest({ngr(f'r{i}', n)}) AS gram FROM seg" for i in range(len(refs)) for n in range(1, 5)
    )
    rl = [f"len(r{i})" for i in range(len(refs))]
    closest = rl[0]
    for other in rl[1:]:
        closest = (f"CASE WHEN abs({other} - len(h)) < abs({closest} - len(h)) OR (abs({other} - len(h)) = abs({closest} - len(h))"
                   f" AND {other} < {closest}) THEN {other} ELSE {closest} END")
    cs = ", ".join(f"coalesce(sum(m) FILTER (WHERE n = {n}), 0) AS c{n}" for n in range(1, 5))
    return f"""seg AS (SELECT {SEG_KEY}, lang, {tok13a('prediction')} AS h, {ref_cols} FROM preds),
hg AS (SELECT {SEG_KEY}, n, gram, count(*) AS c FROM ({hg}) GROUP BY ALL),
rg AS (SELECT {SEG_KEY}, n, gram, max(c) AS c FROM (SELECT {SEG_KEY}, ri, n, gram, count(*) AS c FROM ({rg}) GROUP BY ALL) GROUP BY ALL),
clip AS (SELECT {SEG_KEY}, n, least(hg.c, coalesce(rg.c, 0)) AS m FROM hg LEFT JOIN rg USING ({SEG_KEY}, n, gram)),
cs AS (SELECT {SEG_KEY}, {cs} FROM clip GROUP BY ALL),
st AS (SELECT {group}, sum(len(h)) AS sys_len, sum({closest}) AS ref_len,
        sum(coalesce(c1, 0)) AS c1, sum(coalesce(c2, 0)) AS c2, sum(coalesce(c3, 0)) AS c3, sum(coalesce(c4, 0)) AS c4,
        sum(greatest(len(h), 0)) AS t1, sum(greatest(len(h) - 1, 0)) AS t2, sum(greatest(len(h) - 2, 0)) AS t3, sum(greatest(len(h) - 3, 0)) AS t4
       FROM seg LEFT JOIN cs USING ({SEG_KEY}) GROUP BY {group})"""


def bleu_select(group: str, rounded: bool = True) -> str:
    def p(n: int) -> str:
        zeros = " + ".join(f"CASE WHEN c{k} = 0 THEN 1 ELSE 0 END" for k in range(1, n + 1))
        return (f"CASE WHEN c1 + c2 + c3 + c4 = 0 OR t{n} = 0 THEN 0.0 WHEN c{n} = 0 THEN 100.0 / (pow(2.0, {zeros}) * t{n})"
                f" ELSE 100.0 * c{n} / t{n} END")

    bp = "CASE WHEN sys_len >= ref_len THEN 1.0 WHEN sys_len > 0 THEN exp(1.0 - CAST(ref_len AS DOUBLE) / sys_len) ELSE 0.0 END"
    r = (lambda x: f"round({x}, 6)") if rounded else (lambda x: x)
    return f"""pr AS (SELECT {group}, {p(1)} AS p1, {p(2)} AS p2, {p(3)} AS p3, {p(4)} AS p4, {bp} AS bp,
        CAST(sys_len AS BIGINT) AS sys_len, CAST(ref_len AS BIGINT) AS ref_len FROM st),
sc AS (SELECT *, CASE WHEN p1 * p2 * p3 * p4 > 0 THEN bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0.0 END AS score FROM pr)
SELECT {group}, {r('score')} AS score, {r('bp')} AS bp, {r('p1')} AS p1, {r('p2')} AS p2, {r('p3')} AS p3, {r('p4')} AS p4, sys_len, ref_len FROM sc"""


ORACLES["tok13a"] = f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {tok13a('text')} AS t FROM documents)"""
ORACLES["ngram_stats"] = with_units(EVAL, stats_cte(["tgt"], "system")) + """
SELECT system, n, CAST(CASE n WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 ELSE c4 END AS BIGINT) AS correct,
       CAST(CASE n WHEN 1 THEN t1 WHEN 2 THEN t2 WHEN 3 THEN t3 ELSE t4 END AS BIGINT) AS total
FROM st, (VALUES (1), (2), (3), (4)) v(n)"""
ORACLES["bleu_corpus"] = with_units(EVAL, stats_cte(["tgt"], "system")) + ",\n" + bleu_select("system")
ORACLES["bleu_by_system_lang"] = with_units(EVAL, stats_cte(["tgt"], "system, lang")) + ",\n" + bleu_select("system, lang")
ORACLES["bleu_multi_ref"] = with_units(EVAL, stats_cte(["tgt", "src"], "system")) + ",\n" + bleu_select("system")
ORACLES["bleu_format"] = with_units(EVAL, stats_cte(["tgt"], "system")) + ",\n" + bleu_select("system", False).replace(
    "SELECT system, score AS score, bp AS bp, p1 AS p1, p2 AS p2, p3 AS p3, p4 AS p4, sys_len, ref_len FROM sc",
    "SELECT system, printf('%.2f', score) AS bleu FROM sc",
)
ORACLES["compare_systems"] = with_units(EVAL, stats_cte(["tgt"], "system, lang")) + ",\n" + bleu_select("system, lang", False).replace(
    "SELECT system, lang, score AS score, bp AS bp, p1 AS p1, p2 AS p2, p3 AS p3, p4 AS p4, sys_len, ref_len FROM sc",
    """SELECT system, lang, round(score, 6) AS score, round(b, 6) AS baseline_score, round(score - b, 6) AS delta
FROM (SELECT *, max(CASE WHEN system = 'echo' THEN score END) OVER (PARTITION BY lang) AS b FROM sc)""",
)

# ---------------------------------------------------------------- incremental file streams

ORACLES["stream_tmx_sft"] = ORACLES["sft_examples"]
ORACLES["stream_lang_codes"] = ORACLES["lang_codes"]

ORACLES["bleu_as_written"] = with_units(EVAL) + f""",
fp AS (SELECT system, arg_min(prediction, (path, tu_idx, lang_pos)) AS prediction FROM preds GROUP BY system),
fh AS (SELECT system, {tok13a('prediction')} AS h FROM fp),
rt AS (SELECT system, path, tu_idx, lang_pos, {tok13a('tgt')} AS r FROM preds),
hg AS (SELECT system, n, gram, count(*) AS c FROM (""" + " UNION ALL ".join(
    f"SELECT system, {n} AS n, unnest({ngr('h', n)}) AS gram FROM fh" for n in range(1, 5)) + """) GROUP BY ALL),
rg AS (SELECT system, n, gram, max(c) AS c FROM (SELECT system, path, tu_idx, lang_pos, n, gram, count(*) AS c FROM (""" + " UNION ALL ".join(
    f"SELECT system, path, tu_idx, lang_pos, {n} AS n, unnest({ngr('r', n)}) AS gram FROM rt" for n in range(1, 5)) + """) GROUP BY ALL) GROUP BY ALL),
cl AS (SELECT system, n, sum(least(hg.c, coalesce(rg.c, 0))) AS m FROM hg LEFT JOIN rg USING (system, n, gram) GROUP BY ALL),
rl AS (SELECT rt.system, arg_min(len(r), (abs(len(r) - len(h)), len(r))) AS ref_len FROM rt JOIN fh USING (system) GROUP BY rt.system),
st AS (SELECT fh.system, len(h) AS sys_len, rl.ref_len,
  coalesce((SELECT m FROM cl WHERE cl.system = fh.system AND n = 1), 0) AS c1,
  coalesce((SELECT m FROM cl WHERE cl.system = fh.system AND n = 2), 0) AS c2,
  coalesce((SELECT m FROM cl WHERE cl.system = fh.system AND n = 3), 0) AS c3,
  coalesce((SELECT m FROM cl WHERE cl.system = fh.system AND n = 4), 0) AS c4,
  greatest(len(h), 0) AS t1, greatest(len(h) - 1, 0) AS t2, greatest(len(h) - 2, 0) AS t3, greatest(len(h) - 3, 0) AS t4
  FROM fh JOIN rl USING (system)),
""" + bleu_select("system")

ORACLES["tmx_pairs_large_files"] = ORACLES["tmx_pairs_training"]

ORACLES["encode_native"] = ORACLES["encode"]

ORACLES["token_problems"] = """
SELECT doc_id, 'ids' AS "array", CASE doc_id % 7 WHEN 0 THEN 'null array' WHEN 1 THEN 'null id' ELSE 'length 2' END AS problem
FROM documents WHERE doc_id % 7 <= 2"""
ORACLES["map_batches_counts"] = """
SELECT doc_id, lang, replace(coalesce(text, ''), chr(10), '|') AS text,
       CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS BIGINT) AS n_lines
FROM documents"""
ORACLES["split_by_url"] = """
SELECT url, page_id, pos, CASE WHEN pos <= floor(CAST(0.8 AS DOUBLE) * n) THEN 'train' ELSE 'valid' END AS split
FROM (SELECT url, page_id, row_number() OVER (ORDER BY url, page_id) AS pos, count(*) OVER () AS n FROM pages)"""
ORACLES["split_with_null_and_outlier_keys"] = """
WITH d AS (SELECT CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id = 1 THEN 1152921504606846976 ELSE doc_id END AS k, doc_id FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY k NULLS FIRST, doc_id) AS pos, count(*) OVER () AS n FROM d)
SELECT k, doc_id, pos, CASE WHEN pos <= floor(CAST(0.8 AS DOUBLE) * n) THEN 'train' ELSE 'valid' END AS split FROM r"""

# Every token is numbered: the vocabulary has no limit (that of ``vocab``, a report, stays).
for _name in ("encode", "pad_mask", "training_table", *(f"labels_{_m}" for _m in ("prompt_masked", "prompt_masked_bos", "collated", "intended", "seq2seq", "seq2seq_pad100"))):
    _size = 5000 if _name in ("encode", "pad_mask") else 2000
    ORACLES[_name] = ORACLES[f"{_name}_all"] = ORACLES[_name].replace(f" QUALIFY row_number() OVER (ORDER BY freq DESC, token) <= {_size - 3}", "")
ORACLES["encode_native"] = ORACLES["encode"]
