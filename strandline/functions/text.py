"""Log text as column expressions: header formats, masking, tokens, event ids, parameters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WILDCARD = "<*>"

# Masking rules per log family, applied in order; every match becomes the wildcard.
MASKS = {
    "block_store": [r"(?<=blk_)[-\d]+", r"\d+\.\d+\.\d+\.\d+", r"(/[-\w]+)+"],
    "supercomputer": [r"(0x)[0-9a-fA-F]+", r"\d+.\d+.\d+.\d+", r"\d+"],
    "cluster": [
        r"(0x)[0-9a-fA-F]+",
        r"\d+\.\d+\.\d+\.\d+",
        r"(?<=Warning: we failed to resolve data source name )[\w\s]+",
        r"\d+",
    ],
}

# ASCII punctuation that separates phrases; the wildcard's own marks are not among them.
PHRASE_MARKS = "!\"#$%&'()+,-./:;=?@[\\]^_`{|}~"


def header_pattern(log_format: str) -> tuple[str, list[str]]:
    """Regular expression and header names of a format such as ``<Date> <Time> <Level>: <Content>``.

    Runs of spaces match any white space; every header is a lazy group; the whole line must match.
    """
    headers: list[str] = []
    pattern = ""
    for literal, header in re.findall(r"([^<>]+)|<([^<>]+)>", log_format):
        if header:
            headers.append(header)
            pattern += "(.*?)"
        else:
            pattern += re.sub(" +", r"\\s+", literal)
    return f"^{pattern}$", headers


def fold_non_ascii(line: Column) -> Column:
    return F.regexp_replace(line, r"[^\x00-\x7F]+", "<NASCII>")


def mask(message: Column, rules: Sequence[str]) -> Column:
    """Apply the rules in order."""
    for rule in rules:
        message = F.regexp_replace(message, rule, WILDCARD)
    return message


def tokens(message: Column) -> Column:
    """White-space tokens; an empty array for a blank message."""
    stripped = strip(message)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, r"\s+"))


def phrases(message: Column) -> Column:
    """Pieces between punctuation marks, blank ones dropped; spaces do not separate."""
    marks = "[" + "".join("\\" + m for m in PHRASE_MARKS) + "]"
    return F.filter(F.split(message, marks), lambda p: F.trim(p) != "")


def event_id(template: Column) -> Column:
    """First 8 hexadecimal digits of the template's md5."""
    return F.substring(F.md5(template), 1, 8)


def has_digit(token: Column) -> Column:
    return token.rlike("[0-9]")


def positional_parameters(message_tokens: Column, template_tokens: Column) -> Column:
    """Tokens of the message at the wildcards of its template."""
    paired = F.zip_with(message_tokens, template_tokens, lambda m, t: F.when(t.contains(WILDCARD), m))
    return F.filter(paired, lambda p: p.isNotNull())


def pattern_parameters(content: Column, template: Column) -> Column:
    """Text captured by the wildcards when the template is read as a pattern; empty when it does not match."""
    # The constant pieces between wildcards are quoted as literals, word by word, with any white space between words.
    pieces = F.split(template, r"<\*>", -1)
    quoted = F.transform(pieces, lambda p: F.array_join(F.transform(F.split(p, " +", -1), lambda w: F.when(w == "", w).otherwise(F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))), r"\s+"))
    pattern = F.concat(F.lit("^"), F.array_join(quoted, "(.*?)"), F.lit("$"))
    groups = F.size(pieces) - 1
    captured = F.transform(F.sequence(F.lit(1), groups), lambda i: F.call_function("regexp_extract", content, pattern, i))
    usable = (groups > 0) & F.call_function("regexp_like", content, pattern)
    return F.when(usable, captured).otherwise(F.array().cast("array<string>"))


def parse_number(text: Column) -> tuple[Column, Column]:
    """Whether a text is a number, and whether it is a whole one."""
    value = text.try_cast("double")
    return value.isNotNull(), value.isNotNull() & (value == F.floor(value))


# Time formats of the three log families.
TIME_FORMATS = {
    "supercomputer": "yyyy-MM-dd-HH.mm.ss.SSSSSS",
    "cluster": "yyyy.MM.dd HH:mm:ss",
    "table": "yyyy-MM-dd.HH:mm:ss",
}


def epoch_seconds(text: Column, family: str) -> Column:
    return F.unix_seconds(F.try_to_timestamp(text, F.lit(TIME_FORMATS[family])))


def binary_label(text: Column, normal: str = "-") -> Column:
    return F.when(text != normal, 1).otherwise(0)


def strip(line: Column) -> Column:
    """Text without white space at its ends."""
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def matching_lines(lines: DataFrame, log_format: str, line: str = "line") -> DataFrame:
    """Lines that match the format, stripped."""
    pattern, _ = header_pattern(log_format)
    return lines.withColumn(line, strip(F.col(line))).filter(F.col(line).rlike(pattern))


# Separators that do not occur in ordinary text; lines that hold them are parsed header by header.
_HEAD, _NEXT = "\x1e", "\x1f"


def parse_headers(lines: DataFrame, log_format: str, line: str = "line") -> DataFrame:
    """Header columns of the lines that match the format; other lines are dropped.

    The pattern runs once and rewrites a matching line as a mark and its headers between separators, whatever their
    number. The fields are exploded from an array of none or one: unlike a filter, this is not copied in front of the
    parse.
    """
    pattern, headers = header_pattern(log_format)
    text = strip(F.col(line))
    replacement = _NEXT.join([_HEAD, *(f"${i + 1}" for i in range(len(headers)))])
    quick = F.filter(
        F.array(F.split(F.regexp_replace(text, pattern, replacement), _NEXT)), lambda h: h[0] == _HEAD
    )
    each = [F.regexp_extract(text, pattern, i + 1) for i in range(len(headers))]
    slow = F.array_compact(F.array(F.when(text.rlike(pattern), F.array(F.lit(_HEAD), *each))))
    found = F.when(text.contains(_HEAD) | text.contains(_NEXT), slow).otherwise(quick)
    kept = [c for c in lines.columns if c != line]
    parsed = lines.select(*kept, F.explode(found).alias("_h"))
    return parsed.select(*kept, *[F.col("_h")[i + 1].alias(h) for i, h in enumerate(headers)])
