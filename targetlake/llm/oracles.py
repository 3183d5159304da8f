"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from itertools import permutations

from . import filter_audit, fill_in_middle, mixing, quality_rules, secret_scans

_WORD = r"[^\x20\x09-\x0D]+"


def quality_sql() -> str:
    """Base measures, quantile fences by language and source, and verdicts."""
    measures = {
        "symbols": "n_symbols * 10000.0::DOUBLE / greatest(word_chars, 1)", "dup_lines": "n_dup_lines * 10000.0::DOUBLE / greatest(n_lines, 1)",
        "repeats": "n_repeat_words * 10000.0::DOUBLE / greatest(n_words, 1)", "word_length": "word_chars * 1000.0::DOUBLE / greatest(n_words, 1)",
    }
    sizes = {"chars": "word_chars::DOUBLE", "lines": "n_lines::DOUBLE", "words": "n_words::DOUBLE"}
    gamma, prior = quality_rules.GAMMA, f"{quality_rules.PRIOR}::DOUBLE"
    long = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, CASE WHEN {v} < 1 THEN 0 ELSE floor(ln({v}) / ln({gamma})) + 1 END AS bucket FROM m WHERE NOT base_failed" for k, v in (measures | sizes).items())
    value = lambda measure, q: f"min(mid) FILTER (measure = '{measure}' AND share >= {q})"
    ends = []
    for name, (low, tail, spreads, size, events) in quality_rules.UPPER.items():
        width = f"greatest({value(name, tail)} - {value(name, low)}, {events * quality_rules.SCALE} / greatest({value(size, 0.5)}, 1.0::DOUBLE), {value(name, tail)} * {quality_rules.ERROR}::DOUBLE) * {spreads}"
        ends += [f"{value(name, low)} - {width} AS low_{name}" if name in quality_rules.LOWER else f"NULL::DOUBLE AS low_{name}", f"{value(name, tail)} + {width} AS high_{name}"]
    tests = ", ".join(f"CASE WHEN {v} > high_{k} OR coalesce({v} < low_{k}, false) THEN '{k}' END" for k, v in measures.items())

    def upto(keys: str) -> str:
        """Documents of each group up to each of the table's buckets."""
        same = "".join(f"g.{k} IS NOT DISTINCT FROM c.{k} AND " for k in keys.split(", ") if k)
        own = f"{keys}, " if keys else ""
        grid = f"SELECT g.*, bucket FROM (SELECT {own}measure, sum(n) AS docs FROM s GROUP BY ALL) g JOIN (SELECT DISTINCT measure, bucket FROM s) USING (measure)"
        counts = f"SELECT {own}measure, bucket, sum(n) AS n FROM s GROUP BY ALL"
        return f"""SELECT g.*, sum(coalesce(c.n, 0)) OVER (PARTITION BY {", ".join(f"g.{k}" for k in [*filter(None, keys.split(", ")), "measure"])} ORDER BY g.bucket) AS upto
          FROM ({grid}) g LEFT JOIN ({counts}) c ON {same}g.measure = c.measure AND g.bucket = c.bucket"""

    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
      w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
      g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
      c AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1), (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
      b AS (SELECT doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN c USING (r)),
      m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
      s AS (SELECT lang, source, measure, bucket, count(*) AS n FROM ({long}) GROUP BY ALL),
      ua AS (SELECT measure, bucket, upto::DOUBLE / docs::DOUBLE AS share FROM ({upto("")})),
      ul AS (SELECT u.lang, u.measure, u.bucket, (u.upto::DOUBLE + {prior} * ua.share) / (u.docs::DOUBLE + {prior}) AS share FROM ({upto("lang")}) u JOIN ua USING (measure, bucket)),
      uo AS (SELECT u.lang, u.source, u.measure, (u.upto::DOUBLE + {prior} * ul.share) / (u.docs::DOUBLE + {prior}) AS share, CASE WHEN u.bucket = 0 THEN 0 ELSE pow({gamma}, u.bucket - 0.5) END AS mid
        FROM ({upto("lang, source")}) u JOIN ul ON u.lang IS NOT DISTINCT FROM ul.lang AND u.measure = ul.measure AND u.bucket = ul.bucket),
      f AS (SELECT lang, source, {", ".join(ends)} FROM uo GROUP BY lang, source)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN '' ELSE array_to_string(list_filter([{tests}], lambda x: x IS NOT NULL), ',') END AS broken,
      NOT base_failed AND broken = '' AS kept FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source"""


def secrets_sql() -> str:
    """Spans of every kind from the pieces between matches and the matches."""
    columns, spans = [], []
    quote = lambda x: x.replace("'", "''")
    for order, (kind, (pattern, group, least)) in enumerate(secret_scans.RULES.items()):
        p = quote(pattern)
        columns.append(f"regexp_extract_all(text, '{p}', 0) AS m{order}, regexp_extract_all(text, '{p}', {group}) AS p{order}, string_split_regex(text, '{p}') AS b{order}")
        start = f"list_sum(list_transform(b{order}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{order}[1:i - 1], lambda x: length(x))), 0)"
        spans.append(f"SELECT r, {order} AS k, '{kind}' AS kind, CAST({start} AS BIGINT) AS s, CAST({start} + length(m{order}[i]) AS BIGINT) AS e FROM (SELECT *, unnest(range(1, len(m{order}) + 1)) AS i FROM x) WHERE length(p{order}[i]) >= {least}")
    number = ", ".join(f"coalesce(count(*) FILTER (kind = '{k}'), 0) AS n_{k}" for k in secret_scans.BASE)
    base = ", ".join(f"'{k}'" for k in secret_scans.BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
      x AS (SELECT *, {', '.join(columns)} FROM d), s AS ({' UNION ALL '.join(spans)}),
      t AS (SELECT *, kind || ':' || s || ':' || e AS span FROM s)
      SELECT any_value(doc_id) AS doc_id, {number}, sha256(coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (kind IN ({base})), '')) AS base_sha256,
      coalesce(string_agg(span, ',' ORDER BY s, k), '') AS spans FROM d LEFT JOIN t USING (r) GROUP BY r"""


def decontamination_sql() -> str:
    """Windows of the items joined to the same windows of the documents."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower("coalesce(text, '')")}, '{word}') AS w FROM documents),
      b AS (SELECT item_id, regexp_extract_all({lower("coalesce(text, '')")}, '{word}') AS w FROM benchmark),
      i AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM b WHERE len(w) > 0)),
      z AS (SELECT DISTINCT size FROM i),
      g AS (SELECT r, size, k, array_to_string(w[k:k + size - 1], ' ') AS g FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, z)),
      h AS (SELECT r, g.size, k, item_id FROM g JOIN i ON i.size = g.size AND i.g = g.g),
      n AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT r, k, unnest(range(0, size)) AS j FROM h) GROUP BY r),
      s AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
      SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)"""


def jaccard_sql() -> str:
    """All linked pairs by their common shingles, and the least id reachable."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lower}, '{_WORD}') AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
      l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
      r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.doc_id)
      SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) c USING (doc_id)"""


def mixing_sql() -> str:
    """Targets by the level that fills the budget, and words taken by prefix sums in the order of the keys."""
    hashed = "('0x' || substr(sha256('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text), 1, 13))::BIGINT"
    symbols = "length(text) - length(translate(text, '#*$%&|<>', ''))"
    lines = "string_split(text, chr(10))"
    weight = f"greatest(0.05::DOUBLE, 1.0::DOUBLE - 20.0::DOUBLE * ({symbols}) / (length(text) + 1)) * greatest(0.05::DOUBLE, len(list_distinct({lines}))::DOUBLE / len({lines}))"
    weights = f"({list(mixing.WEIGHTS)})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1]::DOUBLE"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
      m AS (SELECT r, doc_id, source, len(regexp_extract_all(text, '{_WORD}')) AS size, ln(-ln(({hashed}::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)) - ln({weight}) AS key FROM d),
      s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM m GROUP BY source),
      w AS (SELECT *, {weights} AS weight, source_size * {float(mixing.MOST_EPOCHS)}::DOUBLE AS cap FROM s),
      l AS (SELECT max(({mixing.BUDGET}::DOUBLE * total - full_before) / free) AS level FROM (SELECT (SELECT sum(source_size)::DOUBLE FROM s) AS total,
        coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
        sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w WHERE cap > 0)),
      t AS (SELECT source, source_size, least(weight * coalesce(level, 0), cap) AS target FROM w, l),
      e AS (SELECT *, least(CAST(round(target) AS BIGINT), source_size * {mixing.MOST_EPOCHS}) AS words FROM t),
      k AS (SELECT m.*, source_size, target, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs, words - epochs * source_size AS rest FROM m JOIN e ON m.source IS NOT DISTINCT FROM e.source),
      o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k)
      SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM o"""


def audit_sql() -> str:
    """Every order's steps applied to the documents, counted by the filters they fail."""
    bits = {x: 1 << k for k, x in enumerate(filter_audit.FILTERS)}
    orders = ", ".join(f"'{''.join(p)}'" for p in permutations(bits))
    mask = lambda letters: " + ".join(f"CASE WHEN contains({letters}, '{x}') THEN {b} ELSE 0 END" for x, b in bits.items())
    number = lambda test: f"CAST(coalesce(sum(n) FILTER ({test}), 0) AS BIGINT)"
    gone = "mask & before = 0 AND mask & bit <> 0"
    return rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
      f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM d),
      l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
      c AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
      o AS (SELECT unnest([{orders}]) AS filter_order), s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
      b AS (SELECT *, {mask("substr(filter_order, step, 1)")} AS bit, {mask("substr(filter_order, 1, step - 1)")} AS before FROM s),
      r AS (SELECT part, filter_order, step, bit, {number("mask & (before | bit) = 0")} AS kept, {number(gone)} AS removed, {number("mask & before <> 0 AND mask & bit <> 0")} AS redundant,
        {number("mask = bit")} AS unique_fails, {number(gone + " AND good")} AS good_lost, {number(gone + " AND toxic")} AS toxic_lost FROM c, b GROUP BY part, filter_order, step, bit)
      SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""


def fill_in_middle_sql() -> str:
    """Parts by lists of units."""
    h = ", ".join(f"('0x' || substr(x, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    p, s, m = fill_in_middle.PREFIX, fill_in_middle.SUFFIX, fill_in_middle.MIDDLE
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
      u AS (SELECT *, {h}, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t, len(t) AS n FROM d),
      c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
      f AS (SELECT *, CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR h3 % 100 >= {100 - fill_in_middle.PLAIN} THEN 'plain' WHEN h4 % 100 < {fill_in_middle.SPM} THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:n], '') AS suffix FROM c)
      SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM f"""


def oracle_sql() -> dict[str, str]:
    """SQL by query."""
    return {
        "op1_quality_rules": quality_sql(), "op2_secret_scans": secrets_sql(), "op6_benchmark_decontamination": decontamination_sql(), "op8_ngram_jaccard_join": jaccard_sql(),
        "op11_mixing": mixing_sql(), "op12_filter_audit": audit_sql(), "op13_fill_in_middle": fill_in_middle_sql(),
    }
