"""DuckDB SQL for the queries of ``registry``: the same results by another route."""

from __future__ import annotations

from tabulith.functions import papers as fp
from tabulith.functions.cells import BY_PATTERN, BY_WORD, COLUMNS, CONFUSED, DEGREES, ENCODED, HEADERS, ISOTOPE_PAPER, NO_BACKSLASH, RATIO, REGION, SIGMA, SUBTECTONIC, TECTONIC, sm_nd_pattern
from tabulith.functions.text import BLANKS, DIGITS, PUNCTUATION
from tabulith.plans.fixtures import LITHOLOGIES, PAGE_H, PLUTONS, TERMS, ctes

T = "pdf_id, page, table_id"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"trim({c}, {q(BLANKS)})"


def filled(c: str) -> str:
    return f"(length({strip(c)}) > 0)"


def found(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def first_of(*parts: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({p}, '')" for p in parts) + ", '')"


def is_value(c: str) -> str:
    return f"({filled(c)} AND NOT {found(c, '[A-Za-z]')})"


def sm_nd(c: str) -> str:
    return found(c, sm_nd_pattern(DIGITS))


def header_type(c: str) -> str:
    rules = [(" OR ".join(f"contains(lower({c}), {q(w)})" for w in words), name) for name, words in BY_WORD]
    bare = strip(f"lower(regexp_replace(CASE WHEN contains({c}, '(') THEN split_part({c}, '(', 1) ELSE split_part({c}, '[', 1) END, {q(NO_BACKSLASH)}, '', 'g'))")
    rules += [(f"{bare} IN ('sm', 'sm ppm')", "Sm"), (f"{bare} IN ('nd', 'nd ppm')", "Nd")]
    rules += [(found(c, p) + (f" AND NOT contains(lower({c}), 'sr')" if name == SIGMA else ""), name) for name, p in BY_PATTERN]
    return "CASE " + " ".join(f"WHEN {rule} THEN {q(name)}" for rule, name in rules) + " ELSE '' END"


def age(c: str) -> str:
    all_ = f"regexp_extract_all({c}, {q(fp.AGE)}, 0)"
    return f"CASE WHEN len({all_}) > 1 THEN {all_}[1] || ' (?)' WHEN len({all_}) = 1 THEN {all_}[1] ELSE '' END"


def first_term(c: str, kind: str) -> str:
    return f"regexp_extract({c}, {q('(?i)' + fp.term_pattern(TERMS[kind]))}, 0)"


def after_preposition(c: str) -> str:
    return f"CASE WHEN starts_with({c}, 'from') THEN substring({c}, 6) ELSE substring({c}, 4) END"


def places(c: str) -> tuple[str, str, str]:
    parts = f"string_split({after_preposition(strip(f'regexp_extract({c}, {q(fp.PLACES)}, 0)'))}, ',')"
    return tuple(f"CASE WHEN len({parts}) >= {max(2, k)} THEN {parts}[-{k}] ELSE '' END" for k in (1, 2, 3))


def names(c: str) -> tuple[str, str, str]:
    all_ = f"list_transform(regexp_extract_all({c}, {q(fp.NAMES)}, 0), lambda m: {after_preposition(strip('m'))})"
    return tuple(f"CASE WHEN len({all_}) >= {k} THEN {all_}[-{k}] ELSE '' END" for k in (1, 2, 3))


def pluton(c: str) -> str:
    m = strip(f"regexp_extract({c}, {q(fp.PLUTON)}, 0)")
    return f"CASE WHEN {m} = '' THEN '' ELSE substring({m}, 1, length({m}) - 7) END"


def count(c: str, cls: str) -> str:
    """Characters of a class."""
    return f"(length({c}) - length(regexp_replace({c}, {q(cls)}, '', 'g')))"


def split(ratio: str, sigma: str) -> tuple[str, str]:
    paired = f"strpos({ratio}, '(') > 0 AND strpos({ratio}, ')') > strpos({ratio}, '(')"
    inside = f"substring({ratio}, strpos({ratio}, '(') + 1, strpos({ratio}, ')') - strpos({ratio}, '(') - 1)"
    return (
        f"CASE WHEN contains({ratio}, '±') THEN split_part({ratio}, '±', 1) WHEN {paired} THEN split_part({ratio}, '(', 1) ELSE {ratio} END",
        f"CASE WHEN contains({ratio}, '±') THEN split_part({ratio}, '±', 2) WHEN {paired} THEN {inside} ELSE {sigma} END",
    )


def digits(c: str) -> str:
    return f"CASE WHEN contains({c}, '.') THEN regexp_replace(replace({c}, '.', ''), '^0+', '') ELSE {c} END"


def settled(ratio: str, sigma: str) -> tuple[str, str]:
    a, b = split(ratio, sigma)
    return strip(a), strip(digits(f"({b})"))


SHOWN = f"[^{BLANKS}]"
MIXED = f"""({filled("value")} AND {count("value", f"[{DIGITS}!-/:-@\\[-`{{-~Ee±–+]")} / greatest(1, {count("value", SHOWN)}) > 0.7 AND (
  {count("value", "[.]")} - {count("value", "[±–@]")} - len(regexp_extract_all(value, {q(r"\(.*?\)")}, 0)) >= 2 OR {count("value", "±")} >= 2 OR {count("value", "–")} >= 2
  OR (length(value) > 5 AND len(list_distinct(list_transform(range(1, length(value) - 3), lambda i: substring(value, i, 5)))) < length(value) - 4)))"""
QUALITY = f"""quality AS (SELECT *, bad_format OR bad_encoding OR bad_mixture OR bad_text AS bad, NOT (bad_format OR bad_encoding OR bad_mixture OR bad_text) OR has_header AS accepted_extract,
    NOT (bad_format OR bad_encoding OR bad_mixture OR bad_text) AS accepted_fuse
  FROM (SELECT {T},
      count(*) FILTER ({filled("value")}) <= 20 OR max(rid) + 1 <= 5 OR max(cid) + 1 <= 3
        OR coalesce(sum({count("value", " ")}) FILTER ({filled("value")}), 0) / greatest(1, sum(length(value))) > 0.4 AS bad_format,
      bool_or({found("value", ENCODED)}) AS bad_encoding, bool_or({MIXED}) AS bad_mixture,
      bool_or({found("value", CONFUSED)}) OR count(*) FILTER ({filled("value")} AND NOT {found("value", f"[{DIGITS}]")}) / greatest(1, count(*) FILTER ({filled("value")})) > 0.9 AS bad_text,
      bool_or({sm_nd("value")}) AS has_header
    FROM cells GROUP BY {T}))"""

GOOD = f"good AS (SELECT cells.* FROM cells JOIN quality USING ({T}) WHERE accepted_fuse)"
ALL = "good AS (SELECT * FROM cells)"
IN = lambda words: "(" + ", ".join(map(q, words)) + ")"
PRIMARY = f"""heads AS (SELECT {T}, rid AS hr, cid AS hc FROM good WHERE rid < 3 AND {sm_nd("value")} QUALIFY row_number() OVER (PARTITION BY {T} ORDER BY rid, cid) = 1),
typed AS (SELECT {T}, cid, {header_type("value")} AS header FROM good JOIN heads USING ({T}) WHERE rid = hr),
keyed AS (SELECT {T}, hr, hc, sample_cid, pluton_cid FROM heads JOIN (SELECT {T}, max(cid) FILTER (header = 'Sample') AS sample_cid, max(cid) FILTER (header = 'Pluton') AS pluton_cid FROM typed GROUP BY {T}) USING ({T}) WHERE sample_cid IS NOT NULL),
lines AS (SELECT {T}, rid, any_value(pluton_cid) AS pluton_cid, max(value) FILTER (cid = hc) AS probe, max(value) FILTER (cid = sample_cid) AS sample_cell FROM good JOIN keyed USING ({T}) WHERE rid > hr GROUP BY {T}, rid),
rows_ AS (SELECT {T}, rid, {strip("sample_cell")} AS sample, {is_value("probe")} AS is_data,
  last_value(CASE WHEN NOT {is_value("probe")} AND pluton_cid IS NULL AND lower(sample_cell) IN {IN(PLUTONS)} THEN sample_cell END IGNORE NULLS)
    OVER (PARTITION BY {T} ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS row_pluton FROM lines),
each_ AS (SELECT {T}, rid, cid, sample, header, value FROM good JOIN typed USING ({T}, cid) JOIN rows_ USING ({T}, rid) WHERE is_data),
first_facts AS (
  SELECT pdf_id, sample, header, value, 'set' AS mode, 0 AS phase, page, table_id, rid AS a, cid AS b, 0 AS c FROM each_
  UNION ALL SELECT pdf_id, sample, 'Lithology', value, 'ifabsent', 0, page, table_id, rid, cid, 1 FROM each_ WHERE header = '' AND lower(value) IN {IN(LITHOLOGIES)}
  UNION ALL SELECT pdf_id, sample, 'Pluton', row_pluton, 'set', 0, page, table_id, rid, 1000000, 0 FROM rows_ WHERE is_data AND row_pluton IS NOT NULL)"""
SECONDARY = f"""others AS (SELECT good.* FROM good ANTI JOIN heads USING ({T})),
hits AS (SELECT {T}, rid, cid, {strip("value")} AS sample, row_number() OVER (PARTITION BY {T} ORDER BY rid, cid) AS k FROM others o
  WHERE (rid <= 3 OR cid <= 3) AND EXISTS (SELECT 1 FROM rows_ r WHERE r.is_data AND r.pdf_id = o.pdf_id AND r.sample = {strip("o.value")})),
turned AS (SELECT {T}, x.rid AS r1, x.cid AS c1, x.rid = y.rid AS across FROM (SELECT * FROM hits WHERE k = 1) x JOIN (SELECT * FROM hits WHERE k = 2) y USING ({T}) WHERE x.rid = y.rid OR x.cid = y.cid),
second_facts AS (
  SELECT h.pdf_id, h.sample, {header_type("t.value")} AS header, v.value, 'set' AS mode, 1 AS phase, h.page, h.table_id, h.rid AS a, h.cid AS b, v.rid AS c
  FROM hits h JOIN turned USING ({T}) JOIN others v USING ({T}) JOIN others t USING ({T}) WHERE across AND v.cid = h.cid AND v.rid > r1 AND t.cid = 0 AND t.rid = v.rid
  UNION ALL
  SELECT h.pdf_id, h.sample, {header_type("t.value")}, v.value, 'set', 1, h.page, h.table_id, h.rid, h.cid, v.cid
  FROM hits h JOIN turned USING ({T}) JOIN others v USING ({T}) JOIN others t USING ({T}) WHERE NOT across AND v.rid = h.rid AND v.cid > c1 AND t.rid = 0 AND t.cid = v.cid)"""


def upsert(facts: str) -> str:
    """attributes: the last value set, else the first offered, and where a header was first seen."""
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY pdf_id, sample ORDER BY phase, page, table_id, a, b, c) AS g FROM ({facts})),
attributes AS (SELECT pdf_id, sample, header, CASE WHEN count(*) FILTER (mode = 'set') > 0 THEN arg_max(value, g) FILTER (mode = 'set') ELSE arg_min(value, g) FILTER (mode = 'ifabsent') END AS value, min(g) AS first_seq
  FROM numbered GROUP BY pdf_id, sample, header)"""


BOTH = "SELECT * FROM first_facts UNION ALL SELECT * FROM second_facts"


def _defaults() -> str:
    title, abstract, sentence = "title", "abstract", "split_part(abstract, '.', 1)"
    known = {k: first_of(first_term(title, k), first_term(abstract, k)) for k in TERMS}
    at, named, spoken = places(title), names(title), names(sentence)
    steps = ", ".join(
        [f"{known[k]} AS k_{k}" for k in TERMS]
        + [f"{c} AS t{i}" for i, c in enumerate(at)]
        + [f"{c} AS n{i}" for i, c in enumerate(named)]
        + [f"{c} AS s{i}" for i, c in enumerate(spoken)]
    )
    return f"""found_ AS (SELECT *, {steps} FROM papers),
defaults AS (SELECT pdf_id, {first_of("k_geotectonic", "t0", "n0", "s0")} AS geotectonic, {first_of("k_tectonic", "t1", "n1", "s1")} AS tectonic,
  {first_of("k_subtectonic", f"CASE WHEN k_tectonic <> '' THEN {first_of('t2', 't1')} ELSE t2 END", "n2", "s2")} AS subtectonic, k_lithology AS lithology,
  {first_of("k_pluton", pluton(title), pluton(abstract))} AS pluton, {age(abstract)} AS age FROM found_)"""


def _records() -> str:
    wide = ", ".join(f"coalesce(max(value) FILTER (header = {q(h)}), '') AS v{i}" for i, h in enumerate(HEADERS))
    r, s = HEADERS.index(RATIO), HEADERS.index(SIGMA)

    def step(name: str, before: str, *made: tuple[str, str, str]) -> str:
        parts = []
        for label, a, b in made:
            x, y = settled(a, b)
            parts.append(f"{x} AS {label}a, {y} AS {label}b")
        return f"{name} AS (SELECT *, {', '.join(parts)} FROM {before})"

    two = lambda k, one, twice: f"CASE WHEN {k} >= 2 THEN {twice} ELSE {one} END"
    steps = [
        step("w1", "wide", ("none_", "''", f"v{s}"), ("alone1", f"v{r}", "''")),
        step("w2", "w1", ("alone2", "alone1a", "alone1b"), ("before1", f"v{r}", "none_b")),
        "w3 AS (SELECT *, " + two("q - p", "alone1a", "alone2a") + " AS held FROM w2)",
        step("w4", "w3", ("before2", "before1a", "before1b"), ("after1", "held", f"v{s}")),
        step("w5", "w4", ("after2", "after1a", "after1b")),
        "w6 AS (SELECT *, "
        + ", ".join(
            f"CASE WHEN p IS NULL THEN none_{x} WHEN q IS NULL THEN {two('n - p', f'alone1{x}', f'alone2{x}')} WHEN q < p THEN {two('n - p', f'before1{x}', f'before2{x}')} ELSE {two('n - q', f'after1{x}', f'after2{x}')} END AS final_{x}" for x in "ab"
        )
        + " FROM w5)",
    ]
    default = {REGION: "geotectonic", TECTONIC: "tectonic", "Lithology": "lithology", "Pluton": "pluton", "Age(Ma)": "age"}
    shown = []
    for i, h in enumerate(HEADERS):
        c = f"v{i}"
        if h in default:
            c = f"CASE WHEN {c} = '' THEN d.{default[h]} ELSE {c} END"
        elif h == SUBTECTONIC:
            c = f"CASE WHEN {c} = '' AND d.subtectonic <> d.tectonic THEN d.subtectonic ELSE {c} END"
        elif h in (RATIO, SIGMA):
            c = "final_a" if h == RATIO else "final_b"
        shown.append(f'{c} AS "{h}"')
    meta = ["CASE WHEN len(author) > 0 THEN author[1] || ' et al.' ELSE '' END", "year", "journal", "title", "volume", "first_page || '-' || last_page", "doi"]
    shown += [f'{m} AS "{h}"' for m, h in zip(meta, COLUMNS[18:], strict=True)]
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY pdf_id, sample ORDER BY first_seq) - 1 AS place FROM attributes),
wide AS (SELECT pdf_id, sample, {wide}, max(place) FILTER (header = {q(RATIO)}) AS p, max(place) FILTER (header = {q(SIGMA)}) AS q, count(*) AS n FROM placed GROUP BY pdf_id, sample),
{", ".join(steps)},
records AS (SELECT w6.pdf_id, {", ".join(shown)} FROM w6 JOIN papers USING (pdf_id) JOIN defaults d USING (pdf_id))"""


FUSED = f"{ctes('papers', 'cells')},\n{QUALITY},\n{GOOD},\n{PRIMARY},\n{SECONDARY},\n{upsert(BOTH)},\n{_defaults()},\n{_records()}"
PAGE_AREAS = "page_areas AS (SELECT pdf_id, page, table_id, x0 * width AS x0, y0 * height AS y0, x1 * width AS x1, y1 * height AS y1 FROM areas JOIN sheets USING (pdf_id, page))"
INSIDE = "g.x0 >= a.x0 AND g.x1 <= a.x1 AND g.y0 >= a.y0 AND g.y1 <= a.y1"
STRICTLY = "g.x0 > a.x0 AND g.x1 < a.x1 AND g.y0 > a.y0 AND g.y1 < a.y1"
SHRUNK = "g AS (SELECT pdf_id, page, seq, ch, x0 + 0.25 * (x1 - x0) AS x0, y0 + 0.25 * (y1 - y0) AS y0, x1 - 0.25 * (x1 - x0) AS x1, y1 - 0.25 * (y1 - y0) AS y1 FROM glyphs)"
WORDS = """m AS (SELECT *, CASE WHEN lag(x1) OVER o IS NULL OR x0 - lag(x1) OVER o > 3 OR abs(y0 - lag(y0) OVER o) > 3 OR trim(lag(ch) OVER o) = '' THEN 1 ELSE 0 END AS fresh FROM glyphs WINDOW o AS (PARTITION BY pdf_id, page ORDER BY seq)),
words AS (SELECT pdf_id, page, string_agg(ch, '' ORDER BY seq) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY pdf_id, page ORDER BY seq) AS word FROM m) WHERE trim(ch) <> '' GROUP BY pdf_id, page, word)"""


def sessions(values: str) -> str:
    return f"""(SELECT pdf_id, page, min(value) AS first, avg(value) AS mean, sum(n) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY pdf_id, page ORDER BY value) AS session
  FROM (SELECT *, CASE WHEN value - lag(value) OVER (PARTITION BY pdf_id, page ORDER BY value) <= 3 THEN 0 ELSE 1 END AS fresh FROM ({values}))) GROUP BY pdf_id, page, session)"""


PROFILE = "profile AS (SELECT pdf_id, page, (y0 / 12)::INT AS y, count(*) FILTER (ch IN ('g', 'l', 'u')) AS ink FROM glyphs GROUP BY ALL)"
SEPARATORS = """separators AS (SELECT pdf_id, page, min(y) AS start, count(*) AS n, floor(min(y) + 0.5 * (count(*) - 1) + 0.5)::INT AS y
  FROM (SELECT *, y - row_number() OVER (PARTITION BY pdf_id, page ORDER BY y) AS island FROM profile WHERE ink <= 1) GROUP BY pdf_id, page, island)"""
GAPS = """gaps AS (SELECT pdf_id, page, band, min(x) AS "left", max(x) AS "right" FROM (SELECT *, x - row_number() OVER (PARTITION BY pdf_id, page, band ORDER BY x) AS island
    FROM (SELECT pdf_id, page, floor(y0 / 60)::INT AS band, floor(x0 / 6)::INT AS x FROM glyphs GROUP BY ALL HAVING count(*) FILTER (ch IN ('e', 't')) = 0)) GROUP BY pdf_id, page, band, island HAVING max(x) - min(x) >= 2)"""


def sql() -> dict[str, str]:
    p, c, g = ctes("papers"), ctes("cells"), ctes("glyphs")
    at, named = places("title"), names("title")
    cq = f"{c},\n{QUALITY}"
    ga = f"{ctes('glyphs', 'sheets', 'areas')},\n{PAGE_AREAS}"
    tables = f"(SELECT DISTINCT {T} FROM cells)"
    lines = "row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"
    attempts = """WITH attempts AS (SELECT l_suppkey AS pdf_id, l_linenumber AS page, (l_partkey % 10)::INT AS table_id, (l_orderkey % 5)::INT AS attempt,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity > 5 END AS bad, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_partkey % 40 = 0 END AS has_header FROM lineitem)"""
    d = "(SELECT *, list_extract(['up', 'left', 'down', 'right'], (pdf_id % 4 + 1)::INT) AS direction FROM areas)"
    turn = {
        "x0": ("x0", "1 - y1", "1 - x1", "y0"),
        "y0": ("y0", "x0", "1 - y1", "1 - x1"),
        "x1": ("x1", "1 - y0", "1 - x0", "y1"),
        "y1": ("y1", "x1", "1 - y0", "1 - x0"),
    }
    turned = ", ".join(f"CASE pdf_id % 4 WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {e} ELSE {f} END AS {k}" for k, (a, b, e, f) in turn.items())
    out = {
        "literature_filter": f"{p} SELECT pdf_id, title FROM papers WHERE {found('title', ISOTOPE_PAPER)} OR {found('abstract', ISOTOPE_PAPER)}",
        "age_extract": f"{p} SELECT pdf_id, {age('abstract')} AS age FROM papers",
        "keyword_first_match": f"{p} SELECT pdf_id, " + ", ".join(f"{first_term(x, k)} AS {k}_{x}" for k in TERMS for x in ("title", "abstract")) + " FROM papers",
        "tectonic_from_title": f"{p} SELECT pdf_id, {at[0]} AS geotectonic, {at[1]} AS tectonic, {at[2]} AS subtectonic FROM papers",
        "raw_tectonic_names": f"{p} SELECT pdf_id, {named[0]} AS geotectonic, {named[1]} AS tectonic, {named[2]} AS subtectonic FROM papers",
        "pluton_from_text": f"{p} SELECT pdf_id, {pluton('title')} AS in_title, {pluton('abstract')} AS in_abstract FROM papers",
        "paper_defaults": f"{p},\n{_defaults()} SELECT * FROM defaults",
        "resume_antijoin": f"{ctes('papers', 'marks')} SELECT pdf_id, journal FROM papers ANTI JOIN marks USING (pdf_id)",
        "accepted_semijoin": f"{ctes('papers', 'marks')} SELECT pdf_id, journal FROM papers WHERE pdf_id IN (SELECT pdf_id FROM marks WHERE has_header)",
        "extract_tasks": f"{ctes('papers', 'marks', 'sheets', 'areas')} SELECT pdf_id, journal FROM papers WHERE pdf_id IN (SELECT pdf_id FROM areas) AND pdf_id NOT IN (SELECT pdf_id FROM marks WHERE has_header)",
        "fuse_tasks": f"{ctes('cells', 'marks', 'papers')} SELECT {T} FROM {tables} WHERE pdf_id IN (SELECT pdf_id FROM marks WHERE has_header) AND pdf_id IN (SELECT pdf_id FROM papers)",
        "header_typing": f"""SELECT p_partkey, header, {header_type("header")} AS kind, {sm_nd("header")} AS names_sm_nd FROM (SELECT p_partkey, CASE p_partkey % 16 WHEN 0 THEN 'Sample no. ' WHEN 1 THEN 'Percentage '
  WHEN 2 THEN '143Nd/144Nd ' WHEN 3 THEN '147 Sm ' WHEN 4 THEN 'Sm (ppm) ' WHEN 5 THEN 'nd [ppm] ' WHEN 6 THEN '87Sr/86Sr 2σ ' WHEN 7 THEN '± 2 ' WHEN 8 THEN 'ɛNd (t) ' WHEN 9 THEN 'fSm/Nd ' WHEN 10 THEN 'TDM2 '
  WHEN 11 THEN 'Sub Groups ' WHEN 12 THEN 'geotectonic unit ' WHEN 13 THEN 'Rock description ' WHEN 14 THEN 'Nd, ppm ( ' ELSE '' END || p_name AS header FROM part)""",
        "numeric_cell_filter": f"{c} SELECT * FROM cells WHERE {is_value('value')}",
        "uncertainty_split": f"{c} SELECT pdf_id, page, rid, value, {split('value', q(''))[0]} AS ratio, {split('value', q(''))[1]} AS sigma FROM cells WHERE cid = 4",
        "sigma_digits": f"{c} SELECT pdf_id, page, rid, cid, {strip(digits('value'))} AS digits FROM cells WHERE cid IN (5, 6)",
        "table_quality": f"{cq} SELECT * FROM quality",
        "gate_format": f"{cq} SELECT {T}, bad_format FROM quality",
        "gate_encode": f"{cq} SELECT {T}, bad_encoding FROM quality",
        "gate_false_text": f"{cq} SELECT {T}, bad_text FROM quality",
        "gate_mixed_lines": f"{cq} SELECT {T}, bad_mixture FROM quality",
        "table_features": f"""{c} SELECT {T}, (max(cid) + 1) / 20 AS columns, (max(rid) + 1) / 20 AS rows, count(*) FILTER (NOT {filled("value")}) / count(*) AS blank,
  coalesce(sum({count("value", f"[{DIGITS}]")}) FILTER ({filled("value")}), 0) / count(*) AS digits, coalesce(sum({count("value", PUNCTUATION)}) FILTER ({filled("value")}), 0) / count(*) AS punctuation,
  coalesce(sum({count("value", " ")}) FILTER ({filled("value")}), 0) / count(*) AS spaces, count(*) FILTER (contains(value, '(cid')) / count(*) AS encoded,
  count(*) FILTER ({count("value", "[.]")} > 1) / count(*) AS dotted, coalesce(sum(length(value)) FILTER ({filled("value")}), 0) / count(*) AS length FROM cells GROUP BY {T}""",
        "paper_marks": f"{cq} SELECT pdf_id, max((accepted_extract AND has_header)::INT) = 1 AS has_header, '[' || string_agg((accepted_extract AND has_header)::INT::VARCHAR, ',' ORDER BY page, table_id) || ']' AS table_marks FROM quality GROUP BY pdf_id",
        "rule_agreement": f"""{cq}, labels_ AS (SELECT {T}, pdf_id % 7 <> 0 AS available, page = 5 AS encode, pdf_id % 11 = 0 AS format, page IN (2, 7) AS mixed FROM {tables})
SELECT count(*) AS n, avg((bad_format = format)::INT) AS format, avg((bad_encoding = encode OR bad_format)::INT) AS encode, avg((bad_mixture = mixed OR bad_format OR bad_encoding)::INT) AS mixed FROM quality JOIN labels_ USING ({T}) WHERE available""",
        "label_precision": f"""{cq}, judged AS (SELECT NOT (bad_format OR bad_encoding OR bad_mixture) AS good, NOT (page = 5 OR (pdf_id + page) % 6 = 0) AS truth FROM quality)
SELECT count(*) AS n, count(*) FILTER (good AND truth) / nullif(count(*) FILTER (good), 0) AS precision, avg((good = truth)::INT) AS accuracy FROM judged""",
        "attempt_select": f"{attempts} SELECT {T}, attempt, bad, has_header FROM attempts WHERE NOT bad OR has_header QUALIFY row_number() OVER (PARTITION BY {T} ORDER BY attempt, bad, has_header) = 1",
        "attempt_errors": f"{attempts} SELECT pdf_id, 'no grid' AS error, count(*) AS n FROM attempts WHERE bad IS NULL GROUP BY pdf_id",
        "pluton_ffill": f"{c},\n{ALL},\n{PRIMARY} SELECT {T}, rid, sample, is_data, row_pluton FROM rows_",
        "primary_fuse": f"{cq},\n{GOOD},\n{PRIMARY},\n{upsert('SELECT * FROM first_facts')} SELECT pdf_id, sample, header, value FROM attributes",
        "secondary_fuse": f"{cq},\n{GOOD},\n{PRIMARY},\n{SECONDARY},\n{upsert('SELECT * FROM second_facts')} SELECT pdf_id, sample, header, value FROM attributes",
        "final_records": f"{FUSED} SELECT * FROM records",
        "fill_rate": f"{FUSED}, n AS (SELECT " + " + ".join(f'{filled(chr(34) + h + chr(34))}::INT' for h in COLUMNS) + f" AS k FROM records) SELECT coalesce(sum(k), 0)::BIGINT AS filled, (count(*) * {len(COLUMNS)} - coalesce(sum(k), 0))::BIGINT AS blank, sum(k) / nullif(count(*) * {len(COLUMNS)}, 0) AS rate FROM n",
        "glyph_cell_text": f"""{ga}, {SHRUNK}, k AS (SELECT unnest(range(4))::INT AS k), a AS (SELECT pdf_id, page, r.k AS rid, c.k AS cid, x0 + (x1 - x0) * c.k / 4 AS x0, y0 + (y1 - y0) * r.k / 4 AS y0,
  x0 + (x1 - x0) * (c.k + 1) / 4 AS x1, y0 + (y1 - y0) * (r.k + 1) / 4 AS y1 FROM page_areas, k r, k c)
SELECT pdf_id, page, rid, cid, coalesce(string_agg(g.ch, '' ORDER BY g.seq), '') AS text FROM a LEFT JOIN g ON a.pdf_id = g.pdf_id AND a.page = g.page AND {INSIDE} GROUP BY a.pdf_id, a.page, rid, cid""".replace("SELECT pdf_id, page, rid, cid, coalesce", "SELECT a.pdf_id, a.page, rid, cid, coalesce"),
        "space_insertion": f"""{g}, w AS (SELECT *, coalesce(abs(lead(x0) OVER o - x1) > size * 0.8 / 3 OR abs(lead(y1) OVER o - y1) > size * 0.8 / 3, false) AS gap FROM glyphs WINDOW o AS (PARTITION BY pdf_id, page ORDER BY seq))
SELECT pdf_id, page, count(*) FILTER (gap) AS inserted, string_agg(CASE WHEN gap THEN ch || ' ' ELSE ch END, '' ORDER BY seq) AS text FROM w GROUP BY pdf_id, page""",
        "space_duplication": f"""{g}, w AS (SELECT *, lead(ch) OVER (PARTITION BY pdf_id, page ORDER BY seq) AS after FROM glyphs)
SELECT pdf_id, page, count(*) + count(*) FILTER (after = ' ') AS n, count(*) FILTER (after = ' ') AS blanks, sum(x1) + coalesce(sum(x1) FILTER (after = ' '), 0) AS reach FROM w WHERE ch <> ' ' GROUP BY pdf_id, page""",
        "text_layer": f"{ctes('glyphs', 'sheets')} SELECT pdf_id, page, (pdf_id, page) IN (SELECT (pdf_id, page) FROM glyphs WHERE pdf_id % 5 <> 0) AS has_text FROM sheets",
        "direction_vote": f"""{ga}, v AS (SELECT g.pdf_id, g.page, a.table_id, count(*) FILTER (g.x1 - g.x0 > g.y1 - g.y0) AS wide, count(*) FILTER (NOT g.x1 - g.x0 > g.y1 - g.y0) AS high
  FROM glyphs g JOIN page_areas a ON a.pdf_id = g.pdf_id AND a.page = g.page AND {INSIDE} GROUP BY ALL)
SELECT pdf_id, page, table_id, coalesce(wide, 0) AS wide, coalesce(high, 0) AS high, CASE WHEN coalesce(wide + high, 0) >= 10 AND wide >= high THEN 'left' ELSE 'up' END AS direction FROM page_areas LEFT JOIN v USING (pdf_id, page, table_id)""",
        "font_thresholds": f"""{ga}, m AS (SELECT g.pdf_id, g.page, a.table_id, avg(g.size) AS mean FROM glyphs g JOIN page_areas a ON a.pdf_id = g.pdf_id AND a.page = g.page AND {STRICTLY} WHERE g.size <> 0 GROUP BY ALL),
s AS (SELECT DISTINCT pdf_id, page, true AS inked FROM glyphs)
SELECT pdf_id, page, table_id, CASE WHEN inked IS NULL THEN 1.4::DOUBLE ELSE mean * 0.8 END AS space_threshold, CASE WHEN inked IS NULL THEN 50.55555::DOUBLE ELSE trunc(mean * 0.55::DOUBLE * 1.65::DOUBLE * 6::DOUBLE) END AS column_threshold,
  inked IS NOT NULL AND mean IS NULL AS error FROM page_areas LEFT JOIN m USING (pdf_id, page, table_id) LEFT JOIN s USING (pdf_id, page)""",
        "caption_nearest": f"""{ga}, {SHRUNK},
w AS (SELECT *, ch || coalesce(lead(ch, 1) OVER o, '') || coalesce(lead(ch, 2) OVER o, '') || coalesce(lead(ch, 3) OVER o, '') || coalesce(lead(ch, 4) OVER o, '') AS word, lead(ch, 5) OVER o AS after, row_number() OVER o - 1 AS place
  FROM glyphs WINDOW o AS (PARTITION BY pdf_id, page ORDER BY seq)),
best AS (SELECT a.*, w.x0 AS gx, w.y0 AS gy, place, (a.y0 - w.y0) / page_h AS far, page_w FROM page_areas a JOIN w ON a.pdf_id = w.pdf_id AND a.page = w.page
  WHERE word IN ('Table', 'TABLE') AND after IS NOT NULL AND w.y0 < a.y0 QUALIFY row_number() OVER (PARTITION BY a.pdf_id, a.page, a.table_id ORDER BY (a.y0 - w.y0) / page_h, place) = 1),
scan AS (SELECT pdf_id, page, table_id, x0 - greatest(x0 - gx, 0) AS x0, gy AS y0, x1 + greatest(x0 - gx, 0) AS x1, y0 AS y1 FROM best WHERE place > 0 AND far < 0.2 AND (abs(x0 - gx) / page_w < 0.1 OR (x0 < gx AND gx < x1))),
t AS (SELECT a.pdf_id, a.page, a.table_id, string_agg(g.ch, '' ORDER BY g.seq) AS text FROM scan a JOIN g ON a.pdf_id = g.pdf_id AND a.page = g.page AND {INSIDE} GROUP BY ALL)
SELECT pdf_id, page, table_id, coalesce(text, '') AS caption FROM page_areas LEFT JOIN t USING (pdf_id, page, table_id)""",
        "word_boxes": f"{g}, {WORDS} SELECT * FROM words",
        "word_edges": f"""{g}, {WORDS}
SELECT pdf_id, page, 'h' AS kind, trunc(mean)::INT * 6 AS position FROM {sessions("SELECT pdf_id, page, value, count(*) AS n FROM (SELECT pdf_id, page, unnest([y0, y1]) AS value FROM words) GROUP BY ALL")}
UNION ALL SELECT pdf_id, page, 'v', trunc(first)::INT * 6 FROM {sessions("SELECT pdf_id, page, x0 AS value, count(*) AS n FROM words GROUP BY ALL")} WHERE n >= 3
UNION ALL SELECT pdf_id, page, 'v', trunc(max(x1))::INT * 6 FROM words GROUP BY pdf_id, page""",
        "coordinate_cells": f"""SELECT l_suppkey, count(*) FILTER ({filled("value")} AND {found("value", DEGREES)}) AS coordinates, count(*) FILTER (contains(lower(value), 'sample')) AS samples
FROM (SELECT l_suppkey, CASE WHEN l_orderkey % 3 = 0 THEN 'No ' ELSE '' END || (l_partkey % 180) || CASE WHEN l_orderkey % 5 = 0 THEN '(cid:6)' ELSE '°' END || (l_orderkey % 60) || '′' || CASE WHEN l_partkey % 4 = 0 THEN ' SAMPLE' ELSE (l_partkey % 60) || '″N' END AS value FROM lineitem) GROUP BY l_suppkey""",
        "rotate_boxes": f"{ctes('sheets', 'areas')} SELECT pdf_id, page, direction, {turned} FROM {d}",
        "shrink_boxes": f"{ctes('sheets', 'areas')} SELECT pdf_id, page, x0 + 0.25 * (x1 - x0) AS x0, y0 + 0.25 * (y1 - y0) AS y0, x1 - 0.25 * (x1 - x0) AS x1, y1 - 0.25 * (y1 - y0) AS y1 FROM areas",
        "flip_boxes": f"{ctes('sheets', 'areas')}, {PAGE_AREAS} SELECT pdf_id, page, x0, {PAGE_H}::DOUBLE - y1 AS y0, x1, {PAGE_H}::DOUBLE - y0 AS y1 FROM page_areas",
        "confident_detections": f"SELECT *, (row_number() OVER (PARTITION BY pdf_id, page ORDER BY place) - 1)::INT AS table_id FROM (SELECT l_suppkey AS pdf_id, l_linenumber AS page, ({lines})::INT AS place, l_partkey % 100 / 100 AS score FROM lineitem) WHERE score >= 0.9",
        "pixel_boxes": "SELECT l_orderkey, l_partkey, l_linenumber, trunc(l_quantity * 3.7::DOUBLE) / 640 AS x0, trunc(l_quantity * 2.3::DOUBLE) / 800 AS y0, trunc(l_quantity * 9.1::DOUBLE) / 640 AS x1, trunc(l_quantity * 8.9::DOUBLE) / 800 AS y1 FROM lineitem",
        "detection_parse": f"""{ctes("sheets")}, b AS (SELECT 'p' || pdf_id AS pdf_id, page, pdf_id % 3 AS m FROM sheets)
SELECT pdf_id, page, 0 AS table_id, 0.1::DOUBLE AS x0, 0.2::DOUBLE AS y0, 0.9::DOUBLE AS x1, ('0.' || (25 + page))::DOUBLE AS y1 FROM b WHERE m > 0
UNION ALL SELECT pdf_id, page, 1, 0.25, 0.5, 0.75, 1.0 FROM b WHERE m = 2""",
        "row_separators": f"{g}, {PROFILE}, {SEPARATORS} SELECT pdf_id, page, start, n, y FROM separators",
        "separator_bands": f"{g}, {PROFILE}, {SEPARATORS} SELECT * FROM (SELECT pdf_id, page, (row_number() OVER o - 1)::INT AS band, y AS top, lead(y) OVER o AS bottom FROM separators WINDOW o AS (PARTITION BY pdf_id, page ORDER BY y)) WHERE bottom IS NOT NULL",
        "column_gaps": f"{g}, {GAPS} SELECT * FROM gaps",
        "content_blocks": f"""{g}, {GAPS}, w AS (SELECT *, lag("right", 1, 0) OVER o AS before, row_number() OVER o AS k, row_number() OVER (PARTITION BY pdf_id, page, band ORDER BY "left" DESC) AS z FROM gaps WINDOW o AS (PARTITION BY pdf_id, page, band ORDER BY "left"))
SELECT pdf_id, page, band, before AS x0, "left" AS x1, 1 AS kind FROM w WHERE NOT (k = 1 AND "left" = 0) UNION ALL SELECT pdf_id, page, band, "left", "right", 0 FROM w
UNION ALL SELECT pdf_id, page, band, "right", 79, CASE WHEN "right" = 1 THEN 0 ELSE 1 END FROM w WHERE z = 1 AND "right" <> 79""",
        "bands_from_glyphs": f"""{g}, t AS (SELECT pdf_id, page, y0, y1 + CASE WHEN ch IN ('p', 'q', 'g') THEN 4 ELSE 0 END AS y1, seq FROM glyphs WHERE ch <> ' '),
m AS (SELECT *, max(y1) OVER (PARTITION BY pdf_id, page ORDER BY y0, y1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR y0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY pdf_id, page ORDER BY y0, y1, seq ROWS UNBOUNDED PRECEDING) - 1 AS band FROM m)
SELECT pdf_id, page, band::BIGINT AS band, min(y0) AS top, max(y1) AS bottom, count(*) AS glyphs FROM b GROUP BY pdf_id, page, band""",
        "table_meta": f"""{ctes("cells", "printed")}, t AS (SELECT {T}, bool_or(side) AS side, sum(length(value)) AS n, max(rid) AS last FROM printed GROUP BY {T}),
u AS (SELECT *, side AND n >= 10 AS turned, side AND n < 10 AS lies, 16.0 AS a, 56.0 AS b, 590.0 AS c, 72.0 + 12 * last AS d FROM t)
SELECT {T}, CASE WHEN n = 0 THEN 'xml' END AS error, CASE WHEN n > 0 THEN CASE WHEN turned THEN 'left' ELSE 'up' END END AS direction,
  CASE WHEN n > 0 THEN round(CASE WHEN lies THEN b ELSE a END / 620, 6) END AS x0, CASE WHEN n > 0 THEN round(CASE WHEN lies THEN 620 - c ELSE b END / 620, 6) END AS y0,
  CASE WHEN n > 0 THEN round(CASE WHEN lies THEN d ELSE c END / 620, 6) END AS x1, CASE WHEN n > 0 THEN round(CASE WHEN lies THEN 620 - a ELSE d END / 620, 6) END AS y1,
  CASE WHEN n > 0 THEN 8.0::DOUBLE END AS space_threshold, CASE WHEN n > 0 THEN 54.0::DOUBLE END AS column_threshold, 'unframed' AS table_type FROM u""",
        "table_type": "SELECT l_suppkey AS pdf_id, l_linenumber AS page, 0 AS table_id, CASE WHEN sum(l_partkey % 50) > 2000 THEN 'framed' ELSE 'unframed' END AS table_type FROM lineitem GROUP BY ALL",
        "incremental_ingest": "SELECT regexp_extract(url, '://([^/]*)', 1) AS host, count(*) AS pages, sum(length(html))::BIGINT AS chars FROM pages GROUP BY host",
    }
    return out
