"""Column functions over one text column; all map-only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from graphloom import rules as R
from graphloom.rules import RulePack

# White space as Unicode defines it, plus the four ASCII separators: as a class body and as characters.
_SPACE = r"\s\x1c-\x1f"
SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
CJK_BIGRAM = "(?=([一-龥]{2}))"
WORD = "[A-Za-z0-9À-ÿ]+"


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def contains_any(text: Column, words) -> Column:
    """Whether any of the words occurs; one alternation, so a long list stays one expression."""
    return text.rlike("|".join(re.escape(w) for w in words))


def keep_present(*optional: Column) -> Column:
    """Array of the non-null arguments, in argument order."""
    return F.array_compact(F.array(*optional)) if optional else F.array().cast("array<string>")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def squeeze_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)[{_SPACE}]+", " ")


def not_blank(text: Column) -> Column:
    return text.rlike(f"(?U)[^{_SPACE}]")


def stripped_length(text: Column) -> Column:
    return F.length(strip(text))


# --- mentions, cues, conflicts, format ------------------------------------

def mentions_of(text: Column, pattern: str) -> Column:
    # a cheap range check in front spares the long surname class on other scripts
    guard = "(?=[一-龥])" if pattern.startswith("[") and "一-龥" in pattern and "|" not in pattern else ""
    return F.regexp_extract_all(text, F.lit(guard + pattern), F.lit(0))


def mentions(text: Column, patterns) -> Column:
    """Distinct matches of all mention patterns, sorted."""
    return F.sort_array(F.array_distinct(F.concat(*[mentions_of(text, p) for p in patterns])))


def present_cues(text: Column, pack: RulePack = R.ZH) -> Column:
    return keep_present(*[F.when(text.contains(c), F.lit(c)) for c in pack.cues])


def conflict_ids(text: Column, pack: RulePack = R.ZH) -> Column:
    """Ids of the conflict rules whose two words both occur, in rule order."""
    hits = [
        F.when(text.contains(r.subject) & text.contains(r.wrong_object), F.lit(r.rule_id))
        for r in sorted(pack.conflicts, key=lambda r: r.rule_id)
    ]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")


def conflict_messages(text: Column, pack: RulePack = R.ZH) -> Column:
    return keep_present(
        *[
            F.when(text.contains(r.subject) & text.contains(r.wrong_object), F.lit(r.message))
            for r in sorted(pack.conflicts, key=lambda r: r.rule_id)
        ]
    )


def lacks_mark(text: Column, pack: RulePack = R.ZH) -> Column:
    return ~text.rlike(pack.sentence_marks)


def all_upper(text: Column) -> Column:
    return text.rlike(r"\p{IsUppercase}") & ~text.rlike(r"[\p{IsLowercase}\p{Lt}]")


def all_lower(text: Column) -> Column:
    return text.rlike(r"\p{IsLowercase}") & ~text.rlike(r"[\p{IsUppercase}\p{Lt}]")


def format_issues(text: Column, pack: RulePack = R.ZH) -> Column:
    return keep_present(
        F.when(lacks_mark(text, pack), F.lit(R.ISSUE_NO_MARK)),
        F.when(all_upper(text), F.lit(R.ISSUE_ALL_UPPER)).when(all_lower(text), F.lit(R.ISSUE_ALL_LOWER)),
    )


def is_noise(text: Column, pack: RulePack = R.ZH) -> Column:
    return reduce(lambda a, b: a | b, [*[text.contains(w) for w in pack.noise_words], *[text.rlike(p) for p in pack.noise_runs]])


def issue_list(length: Column, n_mentions: Column, n_cues: Column, conflicts: Column, form: Column) -> Column:
    own = keep_present(
        F.when(length < 5, F.lit(R.ISSUE_TOO_SHORT)),
        F.when(n_mentions < 2, F.lit(R.ISSUE_FEW_ENTITIES)),
        F.when(n_cues == 0, F.lit(R.ISSUE_NO_RELATION)),
    )
    return F.concat(own, conflicts, form)


def recommendation(score: Column, issues: Column, threshold: float) -> Column:
    has = lambda issue: F.array_contains(issues, issue)
    advice = keep_present(
        F.when(has(R.ISSUE_TOO_SHORT), F.lit(R.ADVICE_TOO_SHORT)),
        F.when(has(R.ISSUE_FEW_ENTITIES), F.lit(R.ADVICE_FEW_ENTITIES)),
        F.when(has(R.ISSUE_NO_RELATION), F.lit(R.ADVICE_NO_RELATION)),
        F.when(any_issue_with(issues, R.CONFLICT_WORD), F.lit(R.ADVICE_CONFLICT)),
    )
    joined = F.concat_ws(R.ADVICE_SEPARATOR, advice)
    return F.when(score >= threshold, F.lit(R.ADVICE_GOOD)).otherwise(
        F.when(joined == "", F.lit(R.ADVICE_DEFAULT)).otherwise(joined)
    )


def any_issue_with(issues: Column, word: str) -> Column:
    return F.concat_ws("\n", issues).contains(word)


# --- completion -----------------------------------------------------------

def needs_period(text: Column, pack: RulePack = R.ZH) -> Column:
    return ~strip(text).rlike(pack.sentence_marks + r"\z")


def normalise_format(text: Column, pack: RulePack = R.ZH) -> Column:
    ended = F.when(needs_period(text, pack), F.concat(text, F.lit(R.PERIOD))).otherwise(text)
    return strip(squeeze_spaces(ended))


def apply_correction(text: Column, subject: Column, wrong: Column, right: Column) -> Column:
    """Rewrite the four statement forms of a wrong fact, one after the other."""

    def phrase(template, value):
        parts = []
        for piece in template:
            if piece == "{o}":
                parts.append(value)
            elif "{s}" in piece:
                parts += [subject, F.lit(piece.replace("{s}", ""))]
            else:
                parts.append(F.lit(piece))
        return F.concat(*parts)

    for template in R.CORRECTION_TEMPLATES:
        text = F.replace(text, phrase(template, wrong), phrase(template, right))
    return text


def implicit_notes(text: Column, pack: RulePack = R.ZH) -> Column:
    return keep_present(*[F.when(text.contains(w), F.lit(note)) for w, note in pack.implicit_notes])


# --- windows, tokens ------------------------------------------------------

def context_window(text: Column, name: Column, window: int = 50) -> Column:
    """Text around the first mention; empty when the name does not occur."""
    at = F.instr(text, name)
    begin = F.greatest(F.lit(1), at - window)
    return F.when(at > 0, F.substring(text, begin, at + F.length(name) + window - begin)).otherwise(F.lit(""))


def tokens(text: Column) -> Column:
    """Default tokenizer: Latin words and digit runs, and overlapping CJK bigrams.

    No dictionary segmenter is assumed; pass another Column function or a pandas
    UDF wherever an operator takes ``tokenizer``.
    """
    return F.concat(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        F.regexp_extract_all(text, F.lit(CJK_BIGRAM), F.lit(1)),
    )


def entity_text(name: Column, attributes: Column) -> Column:
    return F.concat_ws(" ", name, F.map_values(attributes))
