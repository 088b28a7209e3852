"""The registered queries as DuckDB SQL over the same tables.

``STEPS`` holds the shared steps as common table expressions; each query names
its own SELECT over them.
"""

from __future__ import annotations

from tributary import config

_W = "[^ \\t-\\r]+"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '[ \\t-\\r]+', ' ', 'g'))"


def _ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[ \\t-\\r]+', ' ', 'g'))"


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 7))::BIGINT"


def _collapse(t: str) -> str:
    return (
        f"CASE WHEN len({t}) >= 4 THEN coalesce(list_transform(list_filter(range(2, len({t}) // 2 + 1), lambda b: len({t}) % b = 0 AND "
        f"flatten(list_transform(range(len({t}) // b), lambda k: {t}[1:b])) = {t}), lambda b: {t}[1:b])[1], {t}) ELSE {t} END"
    )


def _weighted(parts: list[tuple[str, float]]) -> str:
    total = " + ".join(["0.0::DOUBLE", *[f"(CASE WHEN {v} IS NULL THEN 0.0::DOUBLE ELSE {w}::DOUBLE END)" for v, w in parts]])
    return "(" + " + ".join(["0.0::DOUBLE", *[f"(CASE WHEN {v} IS NULL THEN 0.0::DOUBLE ELSE {v} * ({w}::DOUBLE / ({total})) END)" for v, w in parts]]) + ")"


def _gate_tokens(x: str) -> str:
    words = "[" + ", ".join(f"'{w}'" for w in config.NUMBER_WORDS) + "]"
    raw = f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9'']+')"
    owner = f"list_transform({raw}, lambda t: CASE WHEN ends_with(t, '''s') THEN t[:-3] WHEN ends_with(t, '''') THEN t[:-2] ELSE t END)"
    stem = (
        f"list_transform({owner}, lambda t: CASE WHEN ends_with(t, 'ies') AND length(t) > 4 THEN left(t, length(t) - 3) || 'y' "
        "WHEN ends_with(t, 'es') AND length(t) > 4 AND NOT ends_with(t, 'ses') THEN left(t, length(t) - 2) "
        "WHEN ends_with(t, 's') AND length(t) > 3 AND NOT ends_with(t, 'ss') AND NOT ends_with(t, 'us') AND NOT ends_with(t, 'is') THEN left(t, length(t) - 1) ELSE t END)"
    )
    owner_fixed = owner.replace("t[:-3]", "left(t, length(t) - 2)").replace("t[:-2]", "left(t, length(t) - 1)")
    stem = stem.replace(owner, owner_fixed)
    return f"list_transform({stem}, lambda t: CASE WHEN list_contains({words}, t) THEN (list_position({words}, t) - 1)::VARCHAR ELSE t END)"


_VISUAL = _weighted([("structure", 0.4), ("rgb", 0.3), ("hist", 0.3)])
_SCORE = _weighted([("visual", 0.45), ("transcript", 0.4), ("dur", 0.1), ("order_prior", 0.05)])
_USED = "concat_ws(',', CASE WHEN visual IS NOT NULL THEN 'visual_similarity' END, CASE WHEN transcript IS NOT NULL THEN 'transcript_similarity' END, CASE WHEN dur IS NOT NULL THEN 'duration_similarity' END, CASE WHEN order_prior IS NOT NULL THEN 'order_similarity' END)"


def _half(x: str, at: int) -> str:
    return f"('0x' || substr({x}, {at}, 8))::BIGINT"


_MARKERS = ", ".join(f"('{c}', '{m.replace(chr(39), chr(39) * 2)}')" for c, group in config.MARKERS.items() for m in group)
_PHRASE_LIST = "[" + ", ".join(f"'{m.replace(chr(39), chr(39) * 2)}'" for group in config.MARKERS.values() for m in group) + "]"
_N_PHRASES = sum(map(len, config.MARKERS.values()))

STEPS = f"""WITH RECURSIVE
nv AS (SELECT count(*) AS n FROM embeddings), nb AS (SELECT count(*) AS n FROM benchmark),
turns AS (SELECT conv_id AS merge_id, turn, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS n_words FROM conversations),
timed AS (SELECT *, row_number() OVER w - 1 AS base_index, (sum(n_words) OVER w)::BIGINT AS done FROM turns WINDOW w AS (PARTITION BY merge_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING)),
base AS (SELECT merge_id, base_index, text, n_words, (done - n_words) * 0.4::DOUBLE AS "start", done * 0.4::DOUBLE AS "end", n_words * 0.4::DOUBLE AS duration, (merge_id * 8 + base_index) % nv.n AS vec FROM timed, nv),
script AS (SELECT *, CASE draw % 10 WHEN 0 THEN 'delete' WHEN 1 THEN 'replace' WHEN 2 THEN 'trim' WHEN 3 THEN 'insert_after' ELSE 'keep' END AS edit
  FROM (SELECT merge_id, base_index, branch, {_draw("merge_id", "base_index", "branch")} AS draw FROM base, (VALUES ('branch_a'), ('branch_b')) AS t(branch))),
edited AS (SELECT b.*, s.branch, s.draw, s.edit, i.text AS item_text, (s.draw // 7) % nv.n AS other
  FROM base b JOIN script s USING (merge_id, base_index) CROSS JOIN nv CROSS JOIN nb JOIN benchmark i ON i.item_id = (s.draw // 10) % nb.n),
put AS (
  SELECT merge_id, branch, base_index, 0 AS sub, CASE edit WHEN 'replace' THEN item_text WHEN 'trim' THEN array_to_string(regexp_extract_all(text, '{_W}')[1:(n_words * 4) // 5], ' ') ELSE text END AS text,
    CASE WHEN edit = 'replace' AND (draw // 1000) % 2 = 0 THEN other ELSE vec END AS vec FROM edited WHERE edit <> 'delete'
  UNION ALL SELECT merge_id, branch, base_index, 1, item_text, other FROM edited WHERE edit = 'insert_after'),
put_timed AS (SELECT *, row_number() OVER w - 1 AS branch_index, (sum(n_words) OVER w)::BIGINT AS done FROM (SELECT *, len(regexp_extract_all(text, '{_W}')) AS n_words FROM put) WINDOW w AS (PARTITION BY merge_id, branch ORDER BY base_index, sub ROWS UNBOUNDED PRECEDING)),
branch AS (SELECT merge_id, branch, branch_index, base_index, sub, text, (done - n_words) * 0.4::DOUBLE AS "start", done * 0.4::DOUBLE AS "end", n_words * 0.4::DOUBLE AS duration, vec FROM put_timed),
raw_features AS (SELECT vec_id AS vec, embedding::DOUBLE[] AS e FROM embeddings),
binned AS (SELECT *, list_transform(e[1:12], lambda x: abs(x)) AS a FROM raw_features),
features AS (SELECT vec,
  array_to_string(list_transform(range(16), lambda i: format('{{:x}}', (CASE WHEN e[4*i+1] > 0 THEN 8 ELSE 0 END) + (CASE WHEN e[4*i+2] > 0 THEN 4 ELSE 0 END) + (CASE WHEN e[4*i+3] > 0 THEN 2 ELSE 0 END) + (CASE WHEN e[4*i+4] > 0 THEN 1 ELSE 0 END))), '') AS hash,
  list_transform([list_reduce(list_prepend(0.0::DOUBLE, e[1:21]), lambda x, y: x + y) / 21.0::DOUBLE, list_reduce(list_prepend(0.0::DOUBLE, e[22:42]), lambda x, y: x + y) / 21.0::DOUBLE, list_reduce(list_prepend(0.0::DOUBLE, e[43:64]), lambda x, y: x + y) / 22.0::DOUBLE], lambda m: greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + m))) AS rgb,
  list_transform(a, lambda x: x / list_reduce(list_prepend(0.0::DOUBLE, a), lambda p, q: p + q)) AS hist FROM binned),
base_p AS (SELECT *, list_filter(string_split(normalized, ' '), lambda x: x <> '') AS tokens, normalized <> '' AS has_speech FROM (SELECT b.*, f.hash, f.rgb, f.hist, {_norm("b.text")} AS normalized FROM base b JOIN features f USING (vec))),
branch_p AS (SELECT *, list_filter(string_split(normalized, ' '), lambda x: x <> '') AS tokens, normalized <> '' AS has_speech FROM (SELECT b.*, f.hash, f.rgb, f.hist, {_norm("b.text")} AS normalized FROM branch b JOIN features f USING (vec))),
base_c AS (SELECT *, {_collapse("tokens")} AS ct FROM base_p), branch_c AS (SELECT *, {_collapse("tokens")} AS ct FROM branch_p),
base_n AS (SELECT merge_id, base_index, tok, count(*) AS n FROM (SELECT merge_id, base_index, unnest(ct) AS tok FROM base_c) GROUP BY ALL),
branch_n AS (SELECT merge_id, branch, branch_index, tok, count(*) AS n FROM (SELECT merge_id, branch, branch_index, unnest(ct) AS tok FROM branch_c) GROUP BY ALL),
common AS (SELECT b.merge_id, b.base_index, r.branch, r.branch_index, sum(least(b.n, r.n))::BIGINT AS low FROM base_n b JOIN branch_n r USING (merge_id, tok) GROUP BY ALL),
parts AS (SELECT b.merge_id, r.branch, b.base_index, r.branch_index, b.hash AS b_hash, r.hash AS r_hash,
  bit_count(xor({_half("b.hash", 1)}, {_half("r.hash", 1)})) + bit_count(xor({_half("b.hash", 9)}, {_half("r.hash", 9)})) AS hamming,
  greatest(0.0::DOUBLE, 1.0::DOUBLE - (abs(b.rgb[1] - r.rgb[1]) + abs(b.rgb[2] - r.rgb[2]) + abs(b.rgb[3] - r.rgb[3])) / 2.0::DOUBLE) AS rgb,
  list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(b.hist, r.hist), lambda z: least(z[1], z[2]))), lambda x, y: x + y) AS hist,
  CASE WHEN len(b.tokens) = 0 AND len(r.tokens) = 0 THEN NULL WHEN len(b.tokens) = 0 OR len(r.tokens) = 0 THEN 0.0::DOUBLE ELSE coalesce(c.low, 0)::DOUBLE / (len(b.ct) + len(r.ct) - coalesce(c.low, 0)) END AS transcript,
  CASE WHEN greatest(b.duration, r.duration) <= 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(b.duration - r.duration) / greatest(b.duration, r.duration)) END AS dur,
  CASE WHEN greatest(b.duration, r.duration) <= 0 THEN 0.0::DOUBLE ELSE abs(b.duration - r.duration) / greatest(b.duration, r.duration) END AS rel_gap,
  greatest(0.0::DOUBLE, 1.0::DOUBLE - greatest(0, r.branch_index - b.base_index) / 4.0::DOUBLE) AS order_prior
  FROM base_c b JOIN branch_c r USING (merge_id) LEFT JOIN common c ON c.merge_id = b.merge_id AND c.base_index = b.base_index AND c.branch = r.branch AND c.branch_index = r.branch_index),
structured AS (SELECT *, CASE WHEN b_hash = repeat('0', 16) AND r_hash = repeat('0', 16) THEN NULL WHEN b_hash = repeat('0', 16) OR r_hash = repeat('0', 16) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - hamming / 64.0::DOUBLE END AS structure FROM parts),
seen AS (SELECT *, {_VISUAL} AS visual FROM structured),
pairs AS (SELECT *, {_SCORE} AS score FROM seen),
skips(j, v) AS (SELECT 0, 0.0::DOUBLE UNION ALL SELECT j + 1, v + -0.05::DOUBLE FROM skips WHERE j < 400),
skip_list AS (SELECT list(v ORDER BY j) AS l FROM skips),
sized AS (SELECT k.merge_id, k.branch, k.n, coalesce(c.m, 0) AS m FROM (SELECT merge_id, branch, count(*) AS n FROM base, (VALUES ('branch_a'), ('branch_b')) AS t(branch) GROUP BY ALL) k LEFT JOIN (SELECT merge_id, branch, count(*) AS m FROM branch GROUP BY ALL) c USING (merge_id, branch)),
mats AS (SELECT merge_id, branch, list(score ORDER BY base_index, branch_index) AS s FROM pairs GROUP BY ALL),
dp(merge_id, branch, n, m, s, k, prev, cur, tb) AS (
  SELECT z.merge_id, z.branch, z.n, z.m, coalesce(t.s, []::DOUBLE[]), 0::BIGINT, l.l[1:z.m + 1], [l.l[2]], '' FROM sized z LEFT JOIN mats t USING (merge_id, branch), skip_list l
  UNION ALL
  SELECT merge_id, branch, n, m, s, k + 1, CASE WHEN j = m - 1 THEN list_append(cur, v) ELSE prev END, CASE WHEN j = m - 1 THEN [l.l[i + 3]] ELSE list_append(cur, v) END, tb || way
  FROM (SELECT *, CASE WHEN c_left > best THEN c_left ELSE best END AS v, CASE WHEN c_left > best THEN 'I' ELSE way_up END AS way FROM (
    SELECT *, CASE WHEN c_up > diag THEN c_up ELSE diag END AS best, CASE WHEN c_up > diag THEN 'D' ELSE 'M' END AS way_up FROM (
      SELECT *, k // m AS i, k % m AS j, prev[(k % m) + 1] + s[k + 1] AS diag, prev[(k % m) + 2] + -0.05::DOUBLE AS c_up, cur[(k % m) + 1] + -0.05::DOUBLE AS c_left FROM dp WHERE k < n * m))), skip_list l),
trace(merge_id, branch, i, j, m, tb, back, base_index, branch_index) AS (
  SELECT merge_id, branch, n, m, m, tb, 0, NULL::BIGINT, NULL::BIGINT FROM dp WHERE k = n * m
  UNION ALL
  SELECT merge_id, branch, CASE WHEN way IN ('M', 'D') THEN i - 1 ELSE i END, CASE WHEN way IN ('M', 'I') THEN j - 1 ELSE j END, m, tb, back + 1, CASE WHEN way IN ('M', 'D') THEN i - 1 END, CASE WHEN way IN ('M', 'I') THEN j - 1 END
  FROM (SELECT *, CASE WHEN i = 0 THEN 'I' WHEN j = 0 THEN 'D' ELSE substr(tb, ((i - 1) * m + j)::BIGINT, 1) END AS way FROM trace WHERE i > 0 OR j > 0)),
steps AS (SELECT merge_id, branch, row_number() OVER (PARTITION BY merge_id, branch ORDER BY back DESC) - 1 AS step, base_index, branch_index FROM trace WHERE back > 0),
joined AS (SELECT s.*, b.text AS base_text, b."start" AS base_start, b."end" AS base_end, b.has_speech AS b_speech, r.normalized AS branch_text, r.text AS branch_raw, r."start" AS branch_start, r."end" AS branch_end, r.has_speech AS r_speech,
  p.visual, p.transcript, p.dur, p.order_prior, p.rel_gap, p.score
  FROM steps s LEFT JOIN base_p b ON b.merge_id = s.merge_id AND b.base_index = s.base_index LEFT JOIN branch_p r ON r.merge_id = s.merge_id AND r.branch = s.branch AND r.branch_index = s.branch_index
  LEFT JOIN pairs p ON p.merge_id = s.merge_id AND p.branch = s.branch AND p.base_index = s.base_index AND p.branch_index = s.branch_index),
typed AS (SELECT *, CASE WHEN base_index IS NULL THEN 'insert' WHEN branch_index IS NULL THEN 'delete'
  WHEN rel_gap <= 0.10 AND visual >= 0.85 AND ((NOT b_speech AND NOT r_speech) OR coalesce(transcript >= 0.85, false)) THEN 'unchanged'
  WHEN rel_gap > 0 AND rel_gap < 0.30 AND visual >= 0.85 AND ((NOT b_speech AND NOT r_speech) OR coalesce(transcript >= 0.50, false)) THEN 'trim'
  WHEN visual >= 0.50 AND (coalesce(transcript < 0.50, false) OR visual < 0.85) THEN 'replace' ELSE 'uncertain' END AS operation FROM joined),
matches AS (SELECT *, CASE WHEN operation IN ('insert', 'delete') THEN 1.0::DOUBLE ELSE score END AS confidence, CASE WHEN operation IN ('insert', 'delete') THEN '' ELSE {_USED} END AS used FROM typed),
units AS (SELECT merge_id, branch, base_index, branch_index, operation, CASE WHEN operation IN ('unchanged', 'delete', 'replace', 'trim') THEN operation ELSE 'unchanged' END AS kind,
  CASE WHEN operation = 'replace' THEN coalesce(branch_text, '') ELSE '' END AS replacement_text, CASE WHEN operation IN ('trim', 'unchanged') THEN coalesce(branch_text, '') ELSE '' END AS retained_text, confidence FROM matches WHERE base_index IS NOT NULL),
inserts AS (SELECT merge_id, branch, branch_index, branch_text AS text, branch_start AS "start", branch_end AS "end" FROM matches WHERE base_index IS NULL),
attached AS (SELECT i.merge_id, i.branch, i.branch_index, i."start", coalesce((SELECT max(b.base_index) FROM base b WHERE b.merge_id = i.merge_id AND b."end" <= i."start"), 0) AS anchor FROM inserts i),
slices0 AS (SELECT b.merge_id, b.base_index, b.text, ua.kind AS a_kind, ub.kind AS b_kind, coalesce(ua.kind, 'unchanged') AS ka, coalesce(ub.kind, 'unchanged') AS kb, ua.replacement_text AS ra, ub.replacement_text AS rb, ua.retained_text AS ta, ub.retained_text AS tb, ua.confidence AS ca, ub.confidence AS cb,
  (SELECT count(*) FROM attached x WHERE x.merge_id = b.merge_id AND x.anchor = b.base_index) AS n_inserts
  FROM base b LEFT JOIN units ua ON ua.merge_id = b.merge_id AND ua.base_index = b.base_index AND ua.branch = 'branch_a' LEFT JOIN units ub ON ub.merge_id = b.merge_id AND ub.base_index = b.base_index AND ub.branch = 'branch_b'),
slices1 AS (SELECT *, CASE WHEN n_inserts > 0 THEN 'unresolved' WHEN ka = 'unchanged' AND kb = 'unchanged' THEN 'preserved' WHEN (ka = 'delete' AND kb IN ('unchanged', 'delete')) OR (ka = 'unchanged' AND kb = 'delete') THEN 'deleted'
  WHEN (ka = 'replace' AND kb = 'unchanged') OR (ka = 'unchanged' AND kb = 'replace') OR (ka = 'replace' AND kb = 'replace' AND ra = rb) THEN 'replaced'
  WHEN (ka = 'trim' AND kb = 'unchanged') OR (ka = 'unchanged' AND kb = 'trim') OR (ka = 'trim' AND kb = 'trim' AND ta = tb) THEN 'trimmed' ELSE 'unresolved' END AS verdict FROM slices0),
slices AS (SELECT *, CASE verdict WHEN 'preserved' THEN text WHEN 'replaced' THEN CASE WHEN ka <> 'unchanged' THEN ra ELSE rb END WHEN 'trimmed' THEN CASE WHEN ka <> 'unchanged' THEN ta ELSE tb END ELSE '' END AS combined_text FROM slices1),
branch_view AS (SELECT b.merge_id, t.branch, b.base_index, b.text AS base_text, coalesce(m.operation, 'unchanged') AS operation,
  CASE WHEN m.operation = 'delete' THEN '' WHEN m.operation IN ('replace', 'trim') THEN coalesce(m.branch_text, '') ELSE coalesce(nullif(m.branch_text, ''), nullif(m.branch_raw, ''), b.text) END AS text, coalesce(m.operation = 'delete', false) AS deleted
  FROM base b CROSS JOIN (VALUES ('branch_a'), ('branch_b')) AS t(branch) LEFT JOIN matches m ON m.merge_id = b.merge_id AND m.branch = t.branch AND m.base_index = b.base_index),
combined AS (SELECT merge_id, base_index, CASE verdict WHEN 'preserved' THEN 'unchanged' WHEN 'replaced' THEN 'replace' WHEN 'trimmed' THEN 'trim' WHEN 'deleted' THEN 'delete' ELSE 'uncertain' END AS operation, combined_text AS text, verdict = 'deleted' AS deleted,
  CASE WHEN verdict = 'deleted' THEN greatest(coalesce(ca, 0.0::DOUBLE), coalesce(cb, 0.0::DOUBLE)) WHEN verdict IN ('replaced', 'trimmed') THEN coalesce(ca, cb) END AS confidence FROM slices),
views AS (SELECT merge_id, 'base' AS "view", base_index, text FROM base UNION ALL SELECT merge_id, branch, base_index, text FROM branch_view UNION ALL SELECT merge_id, 'combined', base_index, text FROM combined),
claims AS (SELECT merge_id, format('claim_{{:04d}}', base_index) AS claim_id, base_index, ['fact', 'instruction', 'condition', 'warning'][(h // 3) % 4 + 1] AS claim_type, ['low', 'medium', 'high', 'critical'][(h // 16) % 4 + 1] AS importance, (h // 64) % 2 = 0 AS repeated
  FROM (SELECT *, {_draw("merge_id", "base_index", "'claim'")} AS h FROM base) WHERE h % 3 = 0),
regions AS (SELECT c.merge_id, c.claim_id, p.kind, b."start", b."end" FROM claims c JOIN (VALUES ('evidence', 0), ('equivalent', 1)) AS p(kind, o) ON p.o = 0 OR c.repeated JOIN base b ON b.merge_id = c.merge_id AND b.base_index = c.base_index + p.o),
cuts AS (SELECT u.merge_id, u.branch, b."start" AS cut_start, b."end" AS cut_end FROM units u JOIN base b USING (merge_id, base_index) WHERE u.kind IN ('delete', 'replace')),
projected AS (SELECT r.*, t.branch FROM regions r, (VALUES ('branch_a'), ('branch_b')) AS t(branch) WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.merge_id = r.merge_id AND c.branch = t.branch AND r."end" > c.cut_start AND r."start" < c.cut_end)),
crossed AS (SELECT a.merge_id, a.claim_id, a.kind, a."start", a."end" FROM projected a WHERE a.branch = 'branch_a' AND EXISTS (SELECT 1 FROM projected b WHERE b.branch = 'branch_b' AND b.merge_id = a.merge_id AND b.claim_id = a.claim_id AND b.kind = a.kind AND b."start" = a."start" AND b."end" = a."end")),
alive AS (SELECT merge_id, claim_id, "view", count(*) AS n FROM (SELECT merge_id, claim_id, branch AS "view" FROM projected UNION ALL SELECT merge_id, claim_id, 'combined' FROM crossed) GROUP BY ALL),
every AS (SELECT merge_id, claim_id, "view" FROM claims, (VALUES ('branch_a'), ('branch_b'), ('combined')) AS t("view")),
surrogate AS (SELECT e.*, coalesce(a.n, 0) AS n_regions, CASE WHEN coalesce(a.n, 0) > 0 THEN 'preserved' ELSE 'broken' END AS status FROM every e LEFT JOIN alive a USING (merge_id, claim_id, "view")),
given AS (SELECT merge_id, claim_id, "view", CASE (h // 5) % 4 WHEN 0 THEN 'broken' WHEN 1 THEN 'degraded' ELSE 'preserved' END AS status, ((h // 20) % 101) / 100.0::DOUBLE AS confidence FROM (SELECT *, {_draw("merge_id", "claim_id", '"view"')} AS h FROM every) WHERE h % 5 <> 0),
verdicts AS (SELECT s.merge_id, s.claim_id, s."view", coalesce(g.status, s.status) AS status, coalesce(g.confidence, 1.0::DOUBLE) AS confidence, g.status IS NULL AS surrogate FROM surrogate s LEFT JOIN given g USING (merge_id, claim_id, "view")),
wide AS (SELECT merge_id, claim_id, max(status) FILTER ("view" = 'branch_a') AS a_status, max(status) FILTER ("view" = 'branch_b') AS b_status, max(status) FILTER ("view" = 'combined') AS c_status FROM verdicts GROUP BY ALL),
interactions AS (SELECT w.*, c.claim_type, c.importance, CASE WHEN c_status = 'broken' AND a_status <> 'broken' AND b_status <> 'broken' THEN 'creates_new_conflict' ELSE 'none' END AS interaction,
  CASE WHEN c_status = 'broken' AND a_status <> 'broken' AND b_status <> 'broken' THEN 'R1' WHEN c_status = 'broken' THEN 'R2' WHEN c_status = 'degraded' THEN 'R3' ELSE 'R4' END AS rule_id FROM wide w JOIN claims c USING (merge_id, claim_id)),
overall AS (SELECT m.merge_id, coalesce(max(i.interaction) FILTER (i.interaction = 'creates_new_conflict'), 'none') AS overall_interaction, count(*) FILTER (i.interaction <> 'none') AS explanation_calls FROM (SELECT DISTINCT merge_id FROM base) m LEFT JOIN interactions i USING (merge_id) GROUP BY ALL),
seen_verdicts AS (SELECT merge_id, max(CASE status WHEN 'broken' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END) FILTER ("view" = 'combined') AS severity, avg(confidence) AS mean_confidence, count(*) AS calls FROM verdicts GROUP BY ALL),
expected_draw AS (SELECT merge_id, {_draw("merge_id", "'expected'")} AS e FROM (SELECT DISTINCT merge_id FROM base)),
run_draw AS (SELECT merge_id, run, e, {_draw("merge_id", "run", "'run'")} AS h FROM expected_draw, (SELECT unnest(range(4)) AS run)),
runs AS (SELECT merge_id AS fixture, run, ['none', 'amplifies_existing_issue', 'creates_new_conflict'][h % 3 + 1] AS interaction, ['none', 'amplifies_existing_issue', 'creates_new_conflict'][e % 3 + 1] AS expected,
  {", ".join(f"['preserved', 'degraded', 'broken'][(h // {3 ** (i + 1)}) % 3 + 1] AS {v}_status, ['preserved', 'degraded', 'broken'][(e // {3 ** (i + 1)}) % 3 + 1] AS {v}_expected" for i, v in enumerate("abc"))} FROM run_draw),
run_counts AS (SELECT fixture, interaction, count(*) AS n, min(run) AS first FROM runs GROUP BY ALL),
statuses AS (SELECT fixture, run, 'a' AS "view", a_status AS status FROM runs UNION ALL SELECT fixture, run, 'b', b_status FROM runs UNION ALL SELECT fixture, run, 'c', c_status FROM runs),
status_counts AS (SELECT fixture, "view", status, count(*) AS n, min(run) AS first FROM statuses GROUP BY ALL),
modal_status AS (SELECT fixture, "view", arg_max(status, n * 1000 - first) AS modal, count(*) AS variance, sum(n)::BIGINT AS n_runs FROM status_counts GROUP BY ALL),
gate_raw AS (SELECT m.merge_id AS fixture, m.branch, m.branch_index AS shot_no, coalesce(b.text, '') AS expected, r.text AS recognized FROM matches m JOIN branch r ON r.merge_id = m.merge_id AND r.branch = m.branch AND r.branch_index = m.branch_index LEFT JOIN base b ON b.merge_id = m.merge_id AND b.base_index = m.base_index WHERE m.branch_index IS NOT NULL),
gate_marked AS (SELECT fixture, branch, shot_no, CASE WHEN has_base THEN expected || ' ' || mk ELSE mk END AS expected, CASE WHEN {_draw("shot_no", "fixture")} % 3 > 0 THEN recognized || ' ' || mk ELSE recognized END AS recognized
  FROM (SELECT m.merge_id AS fixture, m.branch, m.branch_index AS shot_no, b.text AS expected, b.text IS NOT NULL AS has_base, r.text AS recognized, {_PHRASE_LIST}[{_draw("m.merge_id", "m.branch", "m.branch_index")} % {_N_PHRASES} + 1] AS mk
        FROM matches m JOIN branch r ON r.merge_id = m.merge_id AND r.branch = m.branch AND r.branch_index = m.branch_index LEFT JOIN base b ON b.merge_id = m.merge_id AND b.base_index = m.base_index WHERE m.branch_index IS NOT NULL)),
gate_lines AS (SELECT fixture, branch, shot_no, list_distinct({_gate_tokens("expected")}) AS e, list_distinct({_gate_tokens("recognized")}) AS r FROM gate_marked),
gate_judged AS (SELECT *, CASE WHEN len(list_distinct(e || r)) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(e, r))::DOUBLE / len(list_distinct(e || r)) END AS similarity FROM gate_lines),
markers AS (SELECT category, marker, {_gate_tokens("marker")} AS parts FROM (VALUES {_MARKERS}) AS t(category, marker)),
missing AS (SELECT fixture, branch, shot_no, category, marker FROM gate_judged, markers WHERE list_has_all(e, parts) AND NOT list_has_all(r, parts)),
flagged AS (SELECT fixture, branch, count(*) AS flagged, count(DISTINCT category) AS categories FROM (SELECT DISTINCT fixture, branch, shot_no, category FROM missing) GROUP BY ALL),
videos AS (SELECT fixture, branch, count(*) AS shots, avg(similarity) AS avg_similarity, min(similarity) AS min_similarity, coalesce(any_value(f.flagged), 0) AS flagged, coalesce(any_value(f.categories), 0) AS categories FROM gate_judged LEFT JOIN flagged f USING (fixture, branch) GROUP BY fixture, branch),
attempts AS (SELECT *, CASE WHEN ok THEN NULL {" ".join(f"WHEN {' OR '.join(f'contains(lower(message), {chr(39)}{t.replace(chr(39), chr(39) * 2)}{chr(39)})' for t in tokens)} THEN '{name}'" for name, tokens in config.FAILURE_TOKENS.items())}
  {" ".join(f"WHEN error_class IN ({', '.join(repr(c) for c in classes)}) THEN '{name}'" for name, classes in config.FAILURE_CLASSES.items())} ELSE 'unknown' END AS category
  FROM (SELECT user_id AS fixture, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS attempt, event_type <> 'error' AS ok, "value" AS elapsed,
    ['Cloud 503 upstream_503', 'ValidationError: missing ''claims''', 'no rule matched', 'connection reset by peer', 'boom'][event_id % 5 + 1] AS message, ['RuntimeError', 'ValueError', 'KeyError', 'TimeoutError', 'JSONDecodeError'][(event_id // 5) % 5 + 1] AS error_class FROM events)),
frames AS (SELECT user_id AS video_id, event_id AS frame, epoch_us(ts) / 1000000.0::DOUBLE AS ts, "value" AS delta FROM events),
islands AS (SELECT *, sum(jump) OVER (PARTITION BY video_id ORDER BY ts, frame ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY video_id ORDER BY ts, frame) > 1 AND delta > 27.0 THEN 1 ELSE 0 END AS jump FROM frames)),
shots AS (SELECT video_id, island::BIGINT AS sequence_index, "start", coalesce(lead("start") OVER (PARTITION BY video_id ORDER BY island), last) AS "end", max(last) OVER (PARTITION BY video_id) - min("start") OVER (PARTITION BY video_id) AS length FROM (SELECT video_id, island, min(ts) AS "start", max(ts) AS last FROM islands GROUP BY ALL)),
segs AS (SELECT merge_id AS video_id, base_index * 3 + part AS seg_no, "start" + a * 0.4::DOUBLE - 0.3::DOUBLE AS "start", "start" + b * 0.4::DOUBLE + 0.5::DOUBLE AS "end", array_to_string(w[a + 1:b], ' ') AS text
  FROM (SELECT *, len(w) * part // 3 AS a, len(w) * (part + 1) // 3 AS b FROM (SELECT *, regexp_extract_all(text, '{_W}') AS w, unnest([0, 1, 2]) AS part FROM base)) WHERE b > a),
lines AS (SELECT b.merge_id AS name, s.branch, b.base_index AS line_index, CASE WHEN s.edit = 'replace' THEN 'line ' || s.draw ELSE b.text END AS text FROM base b JOIN script s USING (merge_id, base_index) WHERE s.edit <> 'delete')
"""

_P = "merge_id, branch, base_index, branch_index"
_JOIN_LINES = "coalesce(string_agg({t}, chr(10) ORDER BY base_index) FILTER (trim({t}) <> ''), '')"
_SAFE = "coalesce(min((status = 'preserved')::INT) FILTER (\"view\" = '{v}'), 1) = 1"

SELECTS = {
    "q01_shots_timeline": 'SELECT merge_id, base_index, round("start", 6) AS "start", round("end", 6) AS "end", normalized, len(tokens) AS n_tokens, has_speech FROM base_p',
    "q02_segment_overlap_join": """SELECT video_id, sequence_index, string_agg(text, ' ' ORDER BY seg_no) AS transcript, count(*) AS n_segments FROM (
      SELECT *, rank() OVER (PARTITION BY video_id, seg_no ORDER BY overlap DESC) AS r FROM (
        SELECT s.video_id, s.seg_no, s.text, b.base_index AS sequence_index, least(s."end", b."end") - greatest(s."start", b."start") AS overlap FROM segs s JOIN base b ON b.merge_id = s.video_id AND s."end" > b."start" AND s."start" < b."end") WHERE overlap > 0) WHERE r = 1 GROUP BY ALL""",
    "q03_tokens_collapse": f"SELECT merge_id, base_index, len(t) AS n_tokens, len(c) AS n_collapsed, array_to_string(c, ' ') AS collapsed FROM (SELECT *, {_collapse('t')} AS c FROM (SELECT *, CASE WHEN base_index % 2 = 0 THEN tokens || tokens ELSE tokens END AS t FROM base_p))",
    "q04_hamming": f"SELECT {_P}, hamming, round(structure, 6) AS structure FROM pairs",
    "q05_histogram_intersection": f"SELECT {_P}, round(hist, 6) AS hist FROM pairs",
    "q06_mean_rgb": f"SELECT {_P}, round(rgb, 6) AS rgb FROM pairs",
    "q07_visual_blend": f"SELECT {_P}, round(visual, 6) AS visual FROM pairs",
    "q08_multiset_jaccard": f"SELECT {_P}, round(transcript, 6) AS transcript FROM pairs",
    "q09_duration_order": f"SELECT {_P}, round(dur, 6) AS dur, round(rel_gap, 6) AS rel_gap, round(order_prior, 6) AS order_prior FROM pairs",
    "q10_final_blend": f"SELECT {_P}, round(score, 6) AS score, {_USED} AS used FROM pairs",
    "q11_pair_matrix": "SELECT merge_id, branch, count(*) AS n_pairs, round(max(score), 6) AS best, round(min(score), 6) AS worst FROM pairs GROUP BY ALL",
    "q12_alignment_steps": "SELECT merge_id, branch, step, base_index, branch_index FROM steps",
    "q13_edit_ops": "SELECT merge_id, branch, step, base_index, branch_index, operation, round(confidence, 6) AS confidence, used FROM matches",
    "q14_neighbours": "SELECT merge_id, branch, step, operation, lag(operation, 1, 'start') OVER w AS previous_match, lead(operation, 1, 'end') OVER w AS next_match FROM matches WINDOW w AS (PARTITION BY merge_id, branch ORDER BY step)",
    "q15_edit_sets": "SELECT merge_id, branch, base_index, kind, replacement_text, retained_text FROM units",
    "q16_insert_attach": 'SELECT merge_id, branch, branch_index, round("start", 6) AS "start", anchor FROM attached',
    "q17_compose": "SELECT merge_id, base_index, a_kind, b_kind, n_inserts, verdict, combined_text FROM slices",
    "q18_combined_text": f"SELECT merge_id, {_JOIN_LINES.format(t='combined_text')} AS lines FROM slices GROUP BY ALL",
    "q19_branch_view": "SELECT merge_id, branch, base_index, operation, text, deleted FROM branch_view",
    "q20_combined_view": "SELECT merge_id, base_index, operation, text, deleted, round(confidence, 6) AS confidence FROM combined",
    "q21_four_views": f'SELECT merge_id, "view", {_JOIN_LINES.format(t="text")} AS lines FROM views GROUP BY ALL',
    "q22_marker_view": f"""SELECT merge_id, branch, base_index, format('shot_{{:04d}} [{{:02d}}:{{:02d}}.{{:03d}}–{{:02d}}:{{:02d}}.{{:03d}}] ', base_index, s // 60000, s // 1000 % 60, s % 1000, e // 60000, e // 1000 % 60, e % 1000) ||
      CASE op WHEN 'delete' THEN '[DELETED in ' || branch || ']' WHEN 'replace' THEN '[REPLACED in ' || branch || ' — see edit list]' WHEN 'trim' THEN '[TRIMMED in ' || branch || '] ' || t WHEN 'uncertain' THEN '[UNCERTAIN in ' || branch || '] ' || t ELSE t END AS line
      FROM (SELECT b.merge_id, m.branch, b.base_index, round(b."start" * 1000)::BIGINT AS s, round(b."end" * 1000)::BIGINT AS e, {_ws("b.text")} AS t, m.operation AS op FROM base b JOIN matches m ON m.merge_id = b.merge_id AND m.base_index = b.base_index)""",
    "q23_claim_projection": 'SELECT merge_id, claim_id, branch, kind, round("start", 6) AS "start", round("end", 6) AS "end" FROM projected',
    "q24_claim_intersection": 'SELECT merge_id, claim_id, kind, round("start", 6) AS "start", round("end", 6) AS "end" FROM crossed',
    "q25_surrogate": 'SELECT merge_id, claim_id, "view", n_regions, status FROM surrogate',
    "q26_verdict_join": 'SELECT merge_id, claim_id, "view", status, round(confidence, 6) AS confidence, surrogate FROM verdicts',
    "q27_interactions": "SELECT merge_id, claim_id, claim_type, importance, a_status, b_status, c_status, interaction, rule_id, CASE WHEN interaction <> 'none' THEN claim_id || ': A ' || a_status || ', B ' || b_status || ', together ' || c_status END AS explanation FROM interactions",
    "q28_overall": """SELECT o.merge_id, overall_interaction, ['preserved', 'degraded', 'broken'][coalesce(severity, 0) + 1] AS overall_impact, round(coalesce(mean_confidence, 0.0::DOUBLE), 6) AS overall_confidence, coalesce(calls, 0) AS evaluation_calls, explanation_calls,
      overall_interaction = 'creates_new_conflict' AS conflict, CASE WHEN overall_interaction = 'creates_new_conflict' THEN 'The edits conflict when combined.' ELSE 'The edits combine safely.' END AS summary FROM overall o LEFT JOIN seen_verdicts s USING (merge_id)""",
    "q29_confidence": 'SELECT "view", status, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM verdicts GROUP BY ALL',
    "q30_api_projection": """SELECT i.merge_id, i.claim_id, i.interaction, i.c_status, e.n_regions, e.first_start, e.last_end, c.base_index, m.text AS combined_text FROM interactions i
      JOIN (SELECT merge_id, claim_id, count(*) AS n_regions, round(min("start"), 6) AS first_start, round(max("end"), 6) AS last_end FROM regions GROUP BY ALL) e USING (merge_id, claim_id) JOIN claims c USING (merge_id, claim_id) JOIN combined m ON m.merge_id = c.merge_id AND m.base_index = c.base_index""",
    "q31_modal": "SELECT fixture, modal, expected, modal = expected AS correct FROM (SELECT fixture, arg_max(interaction, n * 1000 - first) AS modal FROM run_counts GROUP BY ALL) JOIN (SELECT DISTINCT fixture, expected FROM runs) USING (fixture)",
    "q32_variance": "SELECT fixture, count(*) AS variance, sum(n)::BIGINT AS n_runs, any_value(c.n_correct) AS n_correct, string_agg(interaction || '=' || n, ',' ORDER BY interaction || '=' || n) AS distribution FROM run_counts JOIN (SELECT fixture, count(*) FILTER (interaction = expected) AS n_correct FROM runs GROUP BY ALL) c USING (fixture) GROUP BY fixture",
    "q33_per_claim_modal": 'SELECT fixture, "view", modal, variance, n_runs FROM modal_status',
    "q34_axis_accuracy": """SELECT axis, n, correct, round(correct::DOUBLE / n, 6) AS accuracy, correct >= greatest(1, floor(n * 0.75)::BIGINT) AS passed FROM (
      SELECT count(*) AS n, unnest(['a', 'b', 'c', 'all_axes']) AS axis, unnest([count(*) FILTER (a), count(*) FILTER (b), count(*) FILTER (c), count(*) FILTER (a AND b AND c)]) AS correct FROM (
        SELECT fixture, max(modal) FILTER ("view" = 'a') = max(a_expected) AS a, max(modal) FILTER ("view" = 'b') = max(b_expected) AS b, max(modal) FILTER ("view" = 'c') = max(c_expected) AS c FROM modal_status JOIN (SELECT DISTINCT fixture, a_expected, b_expected, c_expected FROM runs) USING (fixture) GROUP BY fixture))""",
    "q35_spike_gate": """SELECT combined_total, combined_correct, branch_total, branch_correct, false_positives, false_negatives, combined_correct >= greatest(1, floor(combined_total * 0.75)::BIGINT) AS passed FROM (
      SELECT count(*) AS combined_total, count(*) FILTER (label = want) AS combined_correct, 2 * count(label) AS branch_total,
        count(*) FILTER (label IS NOT NULL AND (a_status = 'preserved') = (a_expected = 'preserved')) + count(*) FILTER (label IS NOT NULL AND (b_status = 'preserved') = (b_expected = 'preserved')) AS branch_correct,
        count(*) FILTER (label = 'conflict' AND want = 'safe') AS false_positives, count(*) FILTER (label = 'safe' AND want = 'conflict') AS false_negatives
      FROM (SELECT *, CASE WHEN a_status = 'degraded' AND b_status = 'degraded' THEN NULL WHEN c_status = 'broken' THEN 'conflict' ELSE 'safe' END AS label, CASE WHEN c_expected = 'broken' THEN 'conflict' ELSE 'safe' END AS want FROM runs WHERE run = 0))""",
    "q36_alignment_acceptance": """SELECT branch, count(*) AS slots, round(avg(ok::INT), 6) AS slot_accuracy, round(avg(ok::INT) FILTER (edit IN ('delete', 'trim')), 6) AS required_accuracy, round(avg((operation <> 'unchanged')::INT) FILTER (edit IN ('delete', 'replace', 'trim')), 6) AS localisation,
      count(*) FILTER (edit IN ('keep', 'insert_after') AND operation IN ('delete', 'replace')) AS false_edits, count(*) FILTER (confidence < 0.5) AS low_confidence, count(*) FILTER (operation = 'uncertain') AS uncertain
      FROM (SELECT s.branch, s.edit, m.operation, m.confidence, CASE s.edit WHEN 'delete' THEN m.operation = 'delete' WHEN 'replace' THEN m.operation IN ('replace', 'uncertain', 'delete') WHEN 'trim' THEN m.operation = 'trim' ELSE m.operation = 'unchanged' END AS ok FROM script s JOIN matches m USING (merge_id, branch, base_index)) GROUP BY ALL""",
    "q37_marker_scan": "SELECT fixture, branch, shot_no, category, marker FROM missing",
    "q38_gate_similarity": f"SELECT fixture, branch, shot_no, round(CASE WHEN len(list_distinct(e || r)) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(e, r))::DOUBLE / len(list_distinct(e || r)) END, 6) AS similarity FROM (SELECT fixture, branch, shot_no, list_distinct({_gate_tokens('expected')}) AS e, list_distinct({_gate_tokens('recognized')}) AS r FROM gate_raw)",
    "q39_gate_rollup": "SELECT fixture, branch, shots, round(avg_similarity, 6) AS avg_similarity, round(min_similarity, 6) AS min_similarity, flagged, categories FROM videos",
    "q40_eligibility": """SELECT fixture, videos, round(min_similarity, 6) AS min_similarity, flagged, soft_warnings, min_similarity >= 0.5 AS soft_clean, flagged = 0 AS semantically_clean, min_similarity >= 0.5 AND flagged = 0 AS eligible
      FROM (SELECT fixture, count(*) AS videos, min(min_similarity) AS min_similarity, sum(flagged)::BIGINT AS flagged FROM videos GROUP BY ALL) JOIN (SELECT fixture, count(*) FILTER (similarity >= 0.5 AND similarity < 0.75) AS soft_warnings FROM gate_judged GROUP BY ALL) USING (fixture)""",
    "q41_failure_class": "SELECT category, error_class, count(*) AS n, round(sum(elapsed), 6) AS elapsed FROM attempts WHERE NOT ok GROUP BY ALL",
    "q42_attempt_window": """SELECT fixture, attempt, ok, category FROM (SELECT *, coalesce(sum(ok::INT) OVER w, 0) AS won, coalesce(sum((NOT ok)::INT) OVER w, 0) AS lost, coalesce(sum((NOT ok AND category <> 'provider')::INT) OVER w, 0) AS stopped FROM attempts
      WINDOW w AS (PARTITION BY fixture ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE won < 4 AND lost < 12 AND stopped = 0""",
    "q43_counter_delta": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY ALL",
    "q44_candidate_pairs": "SELECT a.merge_id, a.step AS a_step, a.operation AS a_operation, b.step AS b_step, b.operation AS b_operation FROM matches a JOIN matches b ON a.merge_id = b.merge_id AND a.branch = 'branch_a' AND b.branch = 'branch_b'",
    "q45_legacy_projection": f"SELECT o.merge_id, any_value(o.overall_interaction) = 'creates_new_conflict' AS conflict, {', '.join(_SAFE.format(v=v) + f' AS {v}_safe' for v in ('branch_a', 'branch_b', 'combined'))} FROM overall o LEFT JOIN verdicts v USING (merge_id) GROUP BY o.merge_id",
    "q46_json_tolerant": "SELECT event_id, k, k IS NULL AS failed FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 0 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events)",
    "q47_validation_quarantine": "SELECT CASE WHEN event_id % 5 = 0 THEN 'unknown key' WHEN event_id % 11 = 0 THEN 'missing key' WHEN event_id % 13 = 0 THEN 'malformed' ELSE 'sound' END AS problem, count(*) AS n FROM events GROUP BY ALL",
    "q48_normalization_reason": """SELECT video_id, reason, reason IS NOT NULL AS normalized FROM (SELECT p_partkey AS video_id, CASE WHEN p_partkey % 4 = 2 THEN 'video codec' WHEN p_size * 8 <= 0 OR p_size * 6 + p_partkey % 5 <= 0 THEN 'non-positive dimensions' WHEN (p_size * 6 + p_partkey % 5) % 2 <> 0 THEN 'odd dimensions' WHEN p_partkey % 31 <= 0 THEN 'non-positive fps' WHEN p_partkey % 3 = 2 THEN 'audio codec' END AS reason FROM part)""",
    "q49_segmentation_islands": 'SELECT video_id, sequence_index, round("start", 6) AS "start", round("end", 6) AS "end" FROM shots WHERE length > 0',
    "q50_keyframe_asof": 'SELECT s.video_id, s.sequence_index, arg_max(f.frame, (f.ts, f.frame)) AS frame FROM shots s JOIN frames f ON f.video_id = s.video_id AND f.ts <= (s."start" + s."end") / 2 WHERE s.length > 0 AND s."end" > s."start" GROUP BY ALL',
    "q51_apply_edit_script": "SELECT name, branch, line_index, text FROM lines",
    "q52_base_identity_rank": "SELECT name, branch, line_index, row_number() OVER (PARTITION BY name, branch ORDER BY line_index) - 1 AS branch_position FROM lines",
    "q53_marker_argmax": """SELECT merge_id || ':' || base_index AS text_id, CASE greatest(h0, h1, h2, h3) WHEN 0 THEN NULL WHEN h0 THEN 'thanks' WHEN h1 THEN 'french' WHEN h2 THEN 'german' ELSE 'spanish' END AS name, nullif(greatest(h0, h1, h2, h3), 0) AS hits
      FROM (SELECT *, contains(text, 'thank')::INT + contains(text, 'the')::INT AS h0, contains(text, 'tion')::INT + contains(text, 'eau')::INT AS h1, contains(text, 'sch')::INT + contains(text, 'ung')::INT AS h2, contains(text, 'ción')::INT AS h3 FROM base)""",
    "q54_precision_recall": """SELECT tp, fp, fn, tn, round((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS "precision", round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fp::DOUBLE / nullif(fp + tn, 0), 6) AS fpr, round(fn::DOUBLE / nullif(fn + tp, 0), 6) AS fnr
      FROM (SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn, count(*) FILTER (NOT p AND NOT y) AS tn FROM (SELECT interaction = 'creates_new_conflict' AS p, expected = 'creates_new_conflict' AS y FROM runs WHERE run = 0))""",
    "q55_gate_tokens": f"SELECT fixture, shot_no, len(e) AS n_tokens, array_to_string(list_sort(e), ' ') AS tokens FROM (SELECT merge_id AS fixture, base_index AS shot_no, list_distinct({_gate_tokens('x')}) AS e FROM (SELECT *, text || ' Seven allergies, customers'' boxes and glasses' AS x FROM base))",
    "q56_clock_lines": f"""SELECT merge_id, base_index, floor("start")::DOUBLE AS "start", floor("end")::DOUBLE AS "end", {_ws("text")} AS text FROM base""",
    "q57_retry_policy": """SELECT event_id, event_type = 'error' OR regexp_matches(lower(event_type || ' ' || props), 'upstream[_ ]503|overload|tempora(rily|ry) unavailable|rate[_ -]limit[_ ]exceeded|connection[_ ]reset') AND NOT regexp_matches(lower(event_type || ' ' || props), 'invalid[_ ]api[_ ]key|authentication invalid|unauthorized|401') AS retryable,
      CASE WHEN value > 50 THEN value ELSE 2.0::DOUBLE END AS wait FROM events""",
    "q58_edit_metadata": "SELECT merge_id, branch, base_index, branch_index, operation, round(confidence, 6) AS confidence FROM matches WHERE base_index IS NOT NULL AND operation IN ('delete', 'replace', 'trim')",
    "q59_soundness": "SELECT (SELECT count(*) FROM (SELECT 1 FROM units GROUP BY merge_id, branch, base_index HAVING count(*) > 1)) AS duplicates, (SELECT count(*) FROM attached a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.merge_id = a.merge_id AND b.base_index = a.anchor)) AS orphans",
}

_CLOCK = "lpad((round({x} * 1000)::BIGINT // 60000)::VARCHAR, 2, '0') || ':' || lpad((round({x} * 1000)::BIGINT // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((round({x} * 1000)::BIGINT % 1000)::VARCHAR, 3, '0')"
_MMSS = "lpad((floor({x})::BIGINT // 60)::VARCHAR, 2, '0') || ':' || lpad((floor({x})::BIGINT % 60)::VARCHAR, 2, '0')"

SELECTS |= {
    "q60_evidence": """SELECT merge_id, branch, step, operation, CASE operation WHEN 'insert' THEN 'no BASE shot: insert' WHEN 'delete' THEN 'no branch shot: delete'
      WHEN 'unchanged' THEN 'visual ' || format('{:.3f}', round(visual, 3)) || ' >= 0.85 and transcript agrees: unchanged' WHEN 'trim' THEN 'duration differs by ' || format('{:.3f}', round(rel_gap, 3)) || ' < 0.3 and transcript is related: trim'
      WHEN 'replace' THEN 'visual ' || format('{:.3f}', round(visual, 3)) || ' anchors BASE and content differs: replace' ELSE 'no rule matched: uncertain' END AS reason FROM matches""",
    "q61_extraction_payload": f"""SELECT merge_id, string_agg('[' || base_index || '] ' || {_CLOCK.format(x='"start"')} || '-' || {_CLOCK.format(x='"end"')} || ' ' || {_ws("text")}, chr(10) ORDER BY base_index) AS payload FROM base GROUP BY ALL""",
    "q62_evaluation_payload": f"""SELECT c.merge_id, c.claim_id, v."view", 'CLAIM ' || c.claim_id || ' (' || c.claim_type || ', ' || c.importance || '): ' || {_ws("b.text")} || chr(10) || 'VIEW ' || v."view" || ':' || chr(10) || v.payload AS payload
      FROM claims c JOIN base b USING (merge_id, base_index) JOIN (SELECT merge_id, "view", string_agg(text, chr(10) ORDER BY base_index) AS payload FROM views WHERE "view" <> 'base' AND trim(text) <> '' GROUP BY ALL) v ON v.merge_id = c.merge_id""",
    "q63_prose_reconstruction": f"""SELECT merge_id, base_index, '[' || {_MMSS.format(x='"start"')} || '–' || {_MMSS.format(x='"end"')} || '] ' || CASE d WHEN 0 THEN '[deleted]' WHEN 1 THEN '[replaced]' ELSE '''' || t || '''' END || chr(10) || '[00:00–00:01] ''kept.''' AS rebuilt
      FROM (SELECT *, {_ws("text")} AS t, {_draw("merge_id", "base_index", "'prose'")} % 4 AS d FROM base WHERE n_words > 0)""",
    "q64_shot_time_shift": """SELECT b.merge_id AS video_id, b.base_index AS sequence_index, s.seg_no, round(b."start" + (s."start" - b."start"), 6) AS "start", round(b."start" + (s."end" - b."start"), 6) AS "end", s.text
      FROM base b LEFT JOIN segs s ON s.video_id = b.merge_id AND s.seg_no // 3 = b.base_index""",
}

ORACLE_SQL = {name: STEPS + select for name, select in SELECTS.items()}
