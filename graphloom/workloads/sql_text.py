"""SQL twins of the text rules, generated from the same rule packs."""

from __future__ import annotations

from graphloom import rules as R
from graphloom.rules import RulePack
from graphloom.workloads.substrates import ZH_DOCS, plain

_W = r"[\s\p{Z}\x1c-\x1f]+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{_W}|{_W}$', '', 'g')"


def not_blank(t: str) -> str:
    return rf"regexp_matches({t}, '[^\s\p{{Z}}\x1c-\x1f]')"


def joined(listing: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({listing}, {lit(sep)}), '')"


def present(pairs) -> str:
    """List of the values whose condition holds."""
    items = ", ".join(f"CASE WHEN {cond} THEN {lit(v)} END" for cond, v in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)" if items else "CAST([] AS VARCHAR[])"


def has(t: str, word: str) -> str:
    return f"contains({t}, {lit(word)})"


def any_word(t: str, words) -> str:
    return "(" + " OR ".join(has(t, w) for w in words) + ")"


def mentions(t: str, patterns) -> str:
    lists = [f"regexp_extract_all({t}, {lit(p)})" for p in patterns]
    both = lists[0]
    for other in lists[1:]:
        both = f"list_concat({both}, {other})"
    return f"list_sort(list_distinct({both}))"


def upper(t: str) -> str:
    return rf"(regexp_matches({t}, '\p{{Lu}}') AND NOT regexp_matches({t}, '[\p{{Ll}}\p{{Lt}}]'))"


def lower(t: str) -> str:
    return rf"(regexp_matches({t}, '\p{{Ll}}') AND NOT regexp_matches({t}, '[\p{{Lu}}\p{{Lt}}]'))"


def cues(t: str, pack: RulePack) -> str:
    return present([(has(t, c), c) for c in pack.cues])


def conflicts(t: str, pack: RulePack) -> str:
    return present([(f"{has(t, r.subject)} AND {has(t, r.wrong_object)}", r.message) for r in pack.conflicts])


def formats(t: str, pack: RulePack) -> str:
    return present(
        [
            (f"NOT regexp_matches({t}, {lit(pack.sentence_marks)})", R.ISSUE_NO_MARK),
            (upper(t), R.ISSUE_ALL_UPPER),
            (lower(t), R.ISSUE_ALL_LOWER),
        ]
    )


def assessed(source: str, pack: RulePack, extra: str = "") -> str:
    """CTEs that end in ``assessed`` with every quality column; ``extra`` names columns to carry."""
    more = f", {extra}" if extra else ""
    return f"""
source AS ({source}),
scanned AS (SELECT doc_id, text{more}, length({strip('text')}) AS len, len({mentions('text', pack.mention_patterns)}) AS n_m,
  {cues('text', pack)} AS cue, {conflicts('text', pack)} AS conf, {formats('text', pack)} AS form,
  regexp_matches(text, {lit(pack.noise)}) AS noise FROM source),
scored AS (SELECT *, least(1.0, CASE WHEN len > 10 THEN 0.3 ELSE 0 END + CASE WHEN n_m >= 2 THEN 0.3 ELSE 0 END + CASE WHEN len(cue) >= 1 THEN 0.4 ELSE 0 END)::DOUBLE AS completeness,
  greatest(0.0, 1.0 - 0.2 * len(conf) - 0.1 * len(form))::DOUBLE AS consistency, CASE WHEN noise THEN 0.5 ELSE 0.8 END::DOUBLE AS relevance,
  list_concat(list_concat({present([('len < 5', R.ISSUE_TOO_SHORT), ('n_m < 2', R.ISSUE_FEW_ENTITIES), ('len(cue) = 0', R.ISSUE_NO_RELATION)])}, conf), form) AS issues
  FROM scanned),
judged AS (SELECT *, round(0.4 * completeness + 0.4 * consistency + 0.2 * relevance, 3) AS quality_score FROM scored),
assessed AS (SELECT *, quality_score >= 0.5 AS is_high_quality, CASE WHEN quality_score >= 0.5 THEN {lit(R.ADVICE_GOOD)} ELSE
  coalesce(nullif({joined(present([
      (f"list_contains(issues, {lit(R.ISSUE_TOO_SHORT)})", R.ADVICE_TOO_SHORT),
      (f"list_contains(issues, {lit(R.ISSUE_FEW_ENTITIES)})", R.ADVICE_FEW_ENTITIES),
      (f"list_contains(issues, {lit(R.ISSUE_NO_RELATION)})", R.ADVICE_NO_RELATION),
      ("len(conf) > 0", R.ADVICE_CONFLICT)]), R.ADVICE_SEPARATOR)}, ''), {lit(R.ADVICE_DEFAULT)}) END AS recommendation FROM judged)
"""


COUNTRY = {s: o for s, r, o in R.FACTS if r == "country"}


def corrected(t: str, subject: str, wrong: str) -> str:
    right = COUNTRY[subject]
    out = t
    for form in ("{s}是{o}城市", "{o}{s}", "{s}位于{o}", "{s}在{o}"):
        out = f"replace({out}, {lit(form.format(s=subject, o=wrong))}, {lit(form.format(s=subject, o=right))})"
    return out


def needs_period(t: str, pack: RulePack = R.ZH) -> str:
    return f"NOT regexp_matches({strip(t)}, {lit(pack.sentence_marks + '$')})"


def normalised(t: str, pack: RulePack = R.ZH) -> str:
    ended = f"CASE WHEN {needs_period(t, pack)} THEN {t} || '。' ELSE {t} END"
    return strip(f"regexp_replace({ended}, '{_W}', ' ', 'g')")


def completed(source: str, pack: RulePack = R.ZH, extra: str = "") -> str:
    """CTEs that end in ``completed``: every assessed row with its repaired text."""
    fixed, steps, notes = "text", [], []
    for i, r in enumerate(pack.conflicts):
        hit = f"{has('text', r.subject)} AND {has('text', r.wrong_object)}"
        steps.append(f"fix{i} AS (SELECT *, CASE WHEN {hit} THEN {corrected(fixed, r.subject, r.wrong_object)} ELSE {fixed} END AS t{i} FROM {'assessed' if i == 0 else f'fix{i - 1}'})")
        notes.append((hit, R.CORRECTION_MESSAGE.format(type=r.conflict_type, subject=r.subject, right=COUNTRY[r.subject], wrong=r.wrong_object)))
        fixed = f"t{i}"
    last = f"fix{len(pack.conflicts) - 1}" if pack.conflicts else "assessed"
    reform = f"({upper('text')} OR {lower('text')})"
    return (
        assessed(source, pack, extra)
        + "".join(f",\n{s}" for s in steps)
        + f""",
shaped AS (SELECT *, {fixed} AS fixed, CASE WHEN {reform} THEN {normalised(fixed, pack)} ELSE {fixed} END AS enhanced_data,
  list_concat({present(notes)}, {present([(f"{reform} AND {needs_period(fixed, pack)}", R.PERIOD_ADDED)])}) AS corrections FROM {last}),
noted AS (SELECT *, {present([(has('enhanced_data', w), n) for w, n in pack.implicit_notes])} AS completions FROM shaped),
completed AS (SELECT *, round(greatest(0.1, least(1.0, 0.8 - 0.05 * len(completions) + 0.1 * len(corrections))), 3)::DOUBLE AS confidence, enhanced_data <> text AS changed FROM noted)
"""
    )


def entity_class(name: str) -> str:
    parts = [f"WHEN {any_word(name, words)} THEN '{label}'" for label, words in R.FULL_CLASSES_BEFORE_PERSON]
    parts.append(f"WHEN length({name}) <= 4 AND regexp_matches({name}, '[{R.SURNAMES}]') THEN 'Person'")
    parts.append(f"WHEN {any_word(name, R.DATE_WORDS)} THEN 'Date'")
    digits = rf"regexp_matches(regexp_replace({name}, '[.,]', '', 'g'), '^\p{{Nd}}+$')"
    parts.append(f"WHEN {digits} OR {any_word(name, R.NUMBER_WORDS)} THEN 'Number'")
    parts.append(f"WHEN {any_word(name, R.EVENT_WORDS)} THEN 'Event'")
    parts.append(f"WHEN {any_word(name, R.PRODUCT_WORDS)} THEN 'Product'")
    return f"CASE {' '.join(parts)} ELSE 'Other' END"


def entity_class_basic(name: str) -> str:
    parts = [f"WHEN {any_word(name, words)} THEN '{label}'" for label, words in R.BASIC_CLASSES]
    parts.append(f"WHEN length({name}) <= 4 AND regexp_matches({name}, '[{R.BASIC_SURNAMES}]') THEN 'Person'")
    return f"CASE {' '.join(parts)} ELSE 'Other' END"


def good_pair(a: str, b: str) -> str:
    pairs = ", ".join(f"('{x}', '{y}'), ('{y}', '{x}')" for x, y in R.GOOD_TYPE_PAIRS)
    return f"(({a}, {b}) IN ({pairs}))"


def found_confidence(head_in: str, tail_in: str, good: str) -> str:
    return (
        f"least(1.0, CASE WHEN {head_in} AND {tail_in} THEN 0.95 WHEN {head_in} OR {tail_in} THEN 0.9 ELSE 0.85 END"
        f" + CASE WHEN {good} THEN 0.05 ELSE 0 END)::DOUBLE"
    )


def type_similarity(a: str, b: str, compat: bool = False) -> str:
    parts = []
    for x, y, s in R.TYPE_SIMILARITY:
        if not (compat and x > y):
            parts.append(f"WHEN ({a} = '{x}' AND {b} = '{y}') OR ({a} = '{y}' AND {b} = '{x}') THEN {s}")
    return f"CASE {' '.join(parts)} ELSE 0.1 END::DOUBLE"


def rule_triples(source: str, pack: RulePack) -> str:
    """SELECT of (doc_id, head, relation, tail, confidence), one row per distinct match."""
    p = lit(pack.triple_pattern)
    return f"""SELECT doc_id, head, relation, tail, {found_confidence('true', 'true', good_pair(entity_class('head'), entity_class('tail')))} AS confidence
FROM (SELECT doc_id, regexp_extract(hit, {p}, 1) AS head, regexp_extract(hit, {p}, 2) AS relation, regexp_extract(hit, {p}, 3) AS tail
  FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, {p}))) AS hit FROM ({source}) s) h) t"""


ZH = plain(ZH_DOCS)
DOCS = "SELECT doc_id, text FROM documents"
