"""From figures to a verdict that never says more than was checked."""

from __future__ import annotations

from tablecheck.model import Assessment, ParityOptions, ParityResult


def _n(count: int, noun: str) -> str:
    return f"{count:,} {noun}{'' if count == 1 else 's'}"


def assess(result: ParityResult, options: ParityOptions = ParityOptions()) -> Assessment:
    """`match` needs every check passed and every column compared; with columns left out it is `match-with-gaps`."""
    findings: list[str] = []
    gaps: list[str] = []
    if result.source_rows != result.target_rows:
        findings.append(f"The source holds {_n(result.source_rows, 'row')}, the target {_n(result.target_rows, 'row')}.")
    if k := result.keys:
        for count, text in (
            (k.only_source, "found in the source alone"),
            (k.only_target, "found in the target alone"),
            (k.source_duplicates, "repeated in the source"),
            (k.target_duplicates, "repeated in the target"),
        ):
            if count:
                findings.append(f"{_n(count, 'key')} {text}.")
        for count, name in ((k.source_nulls, "source"), (k.target_nulls, "target")):
            if count:
                findings.append(f"{_n(count, 'row')} of the {name} without a complete key, left unmatched.")
    if result.row_sets:
        for count, name, other in ((result.row_sets[0], "source", "target"), (result.row_sets[1], "target", "source")):
            if count:
                findings.append(f"{_n(count, 'row')} of the {name} without an equal row in the {other}.")
    for column in result.columns:
        if column.mismatches:
            findings.append(f"{column.pair.source}: {_n(column.mismatches, 'matched row')} with another value.")

    for names, text in ((result.unpaired_source, "Only in the source, not compared"), (result.unpaired_target, "Only in the target, not compared"), (result.excluded, "Excluded on request")):
        if names:
            gaps.append(f"{text}: {', '.join(names)}.")
    if not result.columns:
        gaps.append("Keys and counts only: no column was compared.")
    in_rows = result.mode == "rows"
    relaxed = [
        text
        for on, text in (
            (options.trim, "outer blanks dropped"),
            (options.ignore_case, "case ignored"),
            (options.empty_as_null, "empty text read as NULL"),
            (options.tolerance > 0 and not in_rows, f"numbers up to {options.tolerance:g} apart accepted"),
        )
        if on
    ]
    if relaxed:
        gaps.append(f"Relaxed comparison: {', '.join(relaxed)}.")
    if options.tolerance > 0 and in_rows:
        gaps.append(f"The tolerance of {options.tolerance:g} was not applied: whole rows are compared exactly.")
    if in_rows:
        gaps.append("Without a key whole rows are compared: a changed value counts as one row lost and one row gained.")
    partial = result.unpaired_source or result.unpaired_target or result.excluded or not result.columns
    return Assessment("differs" if findings else "match-with-gaps" if partial else "match", tuple(findings), tuple(gaps))
