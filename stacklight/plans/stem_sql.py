"""The stemmer as staged SQL, for oracles: a table of words gets the table `stems` (token, term)."""

from __future__ import annotations

from stacklight.functions.text import SUFFIXES

_M = "len(regexp_extract_all({0}, '[aeiouy][^aeiouy]'))"


def _cut(w: str, n: int) -> str:
    return f"left({w}, length({w}) - {n})"


def _stage(name: str, source: str, body: str) -> str:
    return f"{name} AS (SELECT token, CASE WHEN strlen(w) <= 2 THEN w ELSE {body} END AS w FROM {source})"


def stem_sql(words: str, column: str) -> str:
    plural = f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {_cut('w', 2)} WHEN w LIKE '%ses' THEN w WHEN w LIKE '%es' THEN {_cut('w', 1)} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {_cut('w', 1)} ELSE w END"
    past = f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {_M.format(_cut('w', 3))} > 0 THEN {_cut('w', 1)} || ' ' ELSE w END WHEN regexp_matches(w, '[aeiouy].*ed$') THEN {_cut('w', 2)} WHEN regexp_matches(w, '[aeiouy].*ing$') THEN {_cut('w', 3)} ELSE w END"
    cases = " ".join(f"WHEN w LIKE '%{s}' AND strlen(w) > {len(s)} AND {_M.format(_cut('w', len(s)))} > 1 THEN {_cut('w', len(s))}" for s in dict.fromkeys(SUFFIXES))
    last = f"CASE WHEN w LIKE '%e' AND ({_M.format('w')} > 1 OR ({_M.format('w')} = 1 AND NOT regexp_matches(w, '[^aeiouy][aeiouy][bcdfghjklmnpqrstvz0-9_]e$'))) THEN {_cut('w', 1)} ELSE w END"
    return ", ".join([
        f"s0 AS (SELECT {column} AS token, {column} AS w FROM {words})", _stage("s1", "s0", plural), _stage("s2", "s1", past),
        _stage("s3", "s2", f"CASE {cases} ELSE w END"), _stage("s4", "s3", last), "stems AS (SELECT token, w AS term FROM s4)",
    ])
