"""License scans: Aho-Corasick over the words of a text, and a shunting-yard parser for licence expressions.

A text is its lower-cased words (ASCII letters and digits, and all non-ASCII characters); the automaton runs over them
joined by single spaces, so a phrase is found wherever its words stand consecutively, whatever separates them. Two
kinds of patterns are looked for:

* base phrases, each with a label (`BASE`): counted at every place, overlapping ones too;
* notices and identifier tags (`NOTICES`, `TAG`): they add labels. After a tag, the rest of its line is parsed as an
  expression of licence identifiers with AND, OR, WITH and parentheses; a well-formed one adds its licences.

Expressions: WITH binds tightest, then AND, then OR; it stands between one licence and one exception. Names are those of
`LICENSES` (with `+`, `-only` or `-or-later` where a version allows it) and `EXCEPTIONS`, or references such as
`LicenseRef-x`; with another name it is no expression. Each expression is evaluated against a set of accepted licences
(an exception has to be accepted too); a document is accepted if all its expressions are.

Defined cases: null and empty texts have no words, no labels, score 0 and no verdict; ids are cast to long; one very long
line is one line, and any number of matches takes linear time; repeated rows give repeated results; an empty table gives
an empty result; the input's other columns are left aside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import words_of

#: Base phrases and their labels (fixed by the query's contract).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices and their labels.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit-text",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
    "all rights reserved": "reserved",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "cc0": "cc0",
    "public domain": "public-domain",
}
TAG = "spdx license identifier"
_TAG_LINE = re.compile(rb"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?)")
_RANK = {"OR": 1, "AND": 2, "WITH": 3}
#: Names of the SPDX list that expressions may have (fixed list of common ones, lower-cased).
LICENSES = frozenset("0bsd afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 hpnd icu ijg ipl-1.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.0 ofl-1.1 openssl osl-3.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1".split())
EXCEPTIONS = frozenset("autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 libtool-exception linux-syscall-note llvm-exception openjdk-assembly-exception-1.0 qt-gpl-exception-1.0 swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1".split())
#: Licences that a corpus takes where the caller names none: permissive ones and public domain.
ACCEPTED = frozenset("0bsd apache-2.0 bsd-2-clause bsd-3-clause bsl-1.0 cc-by-4.0 cc0-1.0 isc mit mit-0 psf-2.0 python-2.0 unlicense upl-1.0 x11 zlib llvm-exception".split())
_REFERENCE = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+|additionref-[a-z0-9.-]+")
_SUFFIX = re.compile(r"(?:\+|-only|-or-later)$")

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, accepted boolean"


def is_license(name: str) -> bool:
    name = name.lower()
    return name in LICENSES or _SUFFIX.sub("", name) in LICENSES or (_REFERENCE.fullmatch(name) is not None and not name.startswith("additionref"))


def is_exception(name: str) -> bool:
    return name.lower() in EXCEPTIONS or name.lower().startswith("additionref-")


def parse(text: str) -> list[str] | None:
    """The expression in postfix order (shunting-yard), or None if text isn't one. What follows a complete one is ignored, as in `MIT */`."""
    out: list[str] = []
    stack: list[str] = []
    want_name, at, depth, simple = True, 0, 0, False  # simple: the last operand is one licence, so WITH may follow
    while m := _TOKEN.match(text, at):
        token = m[1]
        op = token.upper()
        if want_name:
            after_with = bool(stack) and stack[-1] == "WITH"
            if token == "(" and not after_with:
                stack.append(token)
                depth += 1
            elif not (is_exception(token) if after_with else is_license(token)):
                return None
            else:
                out.append(token)
                want_name, simple = False, not after_with
        elif op in _RANK:
            if op == "WITH" and not simple:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[op]:
                out.append(stack.pop())
            stack.append(op)
            want_name = True
        elif token == ")" and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
            simple = False
        else:
            break
        at = m.end()
    if want_name or depth:
        return None
    return out + stack[::-1]


def identifiers(postfix: list[str]) -> set[str]:
    """The licences of an expression, without exceptions."""
    return {x for x in postfix if x not in _RANK and not is_exception(x)}


def evaluate(postfix: list[str], accepted: set[str]) -> bool:
    """Whether the accepted licences (and exceptions) satisfy the expression; names compare without case.

    A name with `+`, `-only` or `-or-later` is satisfied by itself or by the plain name.
    """
    names = {x.lower() for x in accepted}
    stack: list[bool] = []
    for x in postfix:
        if x in _RANK:
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if x == "OR" else a and b)
        else:
            stack.append(x.lower() in names or _SUFFIX.sub("", x.lower()) in names)
    return stack.pop()


@lru_cache(maxsize=8)
def automaton(patterns: tuple[str, ...]):
    """Aho-Corasick over ` word word `; pyahocorasick keeps all overlapping matches."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        a.add_word(f" {p} ".encode().decode("latin-1"), i)
    a.make_automaton()
    return a


def scan(text: bytes | None, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> tuple:
    """(n_words, starts of base phrases, base labels, all labels, expressions as said, and in postfix order) of one text."""
    words = words_of(text)
    if not words:
        return 0, np.zeros(0, np.int64), set(), set(), [], []
    patterns = (*base, *notices, TAG)
    # UTF-8 bytes as Latin-1: each byte is a character, so nothing has to be decoded.
    line = f" {b' '.join(words).decode('latin-1')} "
    begins, base_labels, labels, tagged = [], set(), set(), False
    for end, i in automaton(patterns).iter(line):
        phrase = patterns[i]
        if i < len(base):
            begins.append(end - len(phrase.encode()))
            base_labels.add(base[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            labels.add(notices[phrase])
    expressions, parsed = [], []
    if tagged:
        for m in _TAG_LINE.finditer(text):
            said = m[1].decode("utf-8", "replace")
            if postfix := parse(said):
                expressions.append(said.strip())
                parsed.append(postfix)
                labels |= {x.lower() for x in identifiers(postfix)}
    # Where each word begins in the line, so that a place in it is a word's number.
    starts = np.zeros(0, np.int64)
    if begins:
        at = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.searchsorted(at, np.array(begins), side="right")
    return len(words), starts, base_labels, labels | base_labels, expressions, parsed


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None, accepted: frozenset[str] = ACCEPTED) -> DataFrame:
    """One row per document with the columns of SCHEMA.

    first_word and last_word are the smallest and largest start of a base phrase; labels are sorted and comma-joined.
    score is the share of licence evidence: 1 - 2 ** -(places of base phrases + other labels + 2 * expressions).
    accepted is whether all expressions are satisfied by the accepted names, null without an expression.
    """
    base, notices = base or BASE, notices if notices is not None else NOTICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                n, starts, base_labels, labels, expressions, parsed = scan(text.as_py(), base, notices)
                weight = len(starts) + len(labels - base_labels) + 2 * len(expressions)
                rows.append((doc_id, n, len(starts), int(starts.min()) if len(starts) else None, int(starts.max()) if len(starts) else None, ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1.0 - 0.5 ** min(weight, 60), expressions, all(evaluate(x, accepted) for x in parsed) if parsed else None))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.bool_()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "accepted"]
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
