"""License scans: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from riskframe.llm.common import LOWER, column, table, whole_text

#: 1 for the bytes of words: digits, a-z and all of non-ASCII characters.
IN_WORD = bytes(int(48 <= b <= 57 or 97 <= b <= 122 or b >= 128) for b in range(256))
_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"

# Phrases that are always looked for, word by word, and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# label, SPDX identifier, regular expression of the name, keyword of the name, address.
# Names are matched in lower case; a blank stands for any run of white space.
LICENSES = [
    ("apache-1.0", "apache-1.0", r"apache (?:software )?licen[sc]e,? (?:version )?1\.0", "apache", ""),
    ("apache-1.1", "apache-1.1", r"apache (?:software )?licen[sc]e,? (?:version )?1\.1", "apache", ""),
    ("apache-2.0", "apache-2.0", r"apache(?: software)?(?: licen[sc]e)?,? ?(?:version |v)?2(?:\.0)?", "apache", r"apache\.org/licenses/license-2\.0"),
    ("mit", "mit", r"(?:mit|expat)(?: licen[sc]e)?", "mit", r"opensource\.org/licenses?/mit"),
    ("mit-0", "mit-0", r"mit no attribution(?: licen[sc]e)?", "mit no attribution", ""),
    ("x11", "x11", r"x11(?: licen[sc]e)", "x11", ""),
    ("isc", "isc", r"isc(?: licen[sc]e)", "isc", r"opensource\.org/licenses?/isc"),
    ("bsd-2-clause", "bsd-2-clause", r"(?:(?:2|two)[- ]clause|simplified|freebsd) bsd(?: licen[sc]e)?|bsd[- ]2[- ]clause", "bsd", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd-3-clause", r"(?:(?:3|three)[- ]clause|new|modified|revised) bsd(?: licen[sc]e)?|bsd[- ]3[- ]clause", "bsd", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd-4-clause", r"(?:(?:4|four)[- ]clause|original) bsd(?: licen[sc]e)?", "bsd", ""),
    ("0bsd", "0bsd", r"(?:zero|0)[- ]clause bsd(?: licen[sc]e)?", "bsd", ""),
    ("bsd", "bsd", r"bsd(?:[- ]style)? licen[sc]e", "bsd", ""),
    ("gpl-1.0", "gpl-1.0(?:-only|-or-later|\\+)?", r"(?:gnu )?(?:general public licen[sc]e|gpl),? ?(?:version |v)1(?:\.0)?", "gnu|gpl|general public", ""),
    ("gpl-2.0", "gpl-2.0(?:-only|-or-later|\\+)?", r"(?:gnu )?(?:general public licen[sc]e|gpl),? ?(?:version |v)2(?:\.0)?", "gnu|gpl|general public", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gpl-3.0(?:-only|-or-later|\\+)?", r"(?:gnu )?(?:general public licen[sc]e|gpl),? ?(?:version |v)3(?:\.0)?", "gnu|gpl|general public", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl", "gpl", r"(?:gnu general public licen[sc]e|gnu gpl)", "gnu", r"gnu\.org/licenses/gpl\b"),
    ("lgpl-2.0", "lgpl-2.0(?:-only|-or-later|\\+)?", r"(?:gnu )?(?:library general public licen[sc]e|lgpl),? ?(?:version |v)2(?:\.0)?", "library general|lgpl", ""),
    ("lgpl-2.1", "lgpl-2.1(?:-only|-or-later|\\+)?", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl),? ?(?:version |v)2\.1", "lesser|lgpl", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lgpl-3.0(?:-only|-or-later|\\+)?", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl),? ?(?:version |v)3(?:\.0)?", "lesser|lgpl", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0", "agpl-3.0(?:-only|-or-later|\\+)?", r"(?:gnu )?(?:affero general public licen[sc]e|agpl),? ?(?:version |v)?3(?:\.0)?", "affero|agpl", r"gnu\.org/licenses/agpl"),
    ("gfdl", "gfdl-1.[123]", r"gnu free documentation licen[sc]e", "free documentation", r"gnu\.org/licenses/fdl"),
    ("mpl-1.1", "mpl-1.1", r"mozilla public licen[sc]e,? ?(?:version |v)?1\.1", "mozilla", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mpl-2.0", r"mozilla public licen[sc]e,? ?(?:version |v)?2(?:\.0)?", "mozilla", r"mozilla\.org/mpl/2\.0"),
    ("epl-1.0", "epl-1.0", r"eclipse public licen[sc]e,? ?(?:version |v|-v )?1\.0", "eclipse", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "epl-2.0", r"eclipse public licen[sc]e,? ?(?:version |v|-v )?2(?:\.0)?", "eclipse", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("edl", "edl-1.0", r"eclipse distribution licen[sc]e", "eclipse", r"eclipse\.org/org/documents/edl"),
    ("cddl-1.0", "cddl-1.0", r"common development and distribution licen[sc]e|cddl", "common development|cddl", ""),
    ("cpl-1.0", "cpl-1.0", r"common public licen[sc]e", "common public", ""),
    ("eupl", "eupl-1.[012]", r"european union public licen[sc]e|eupl", "european union|eupl", r"joinup\.ec\.europa\.eu/.{0,80}eupl"),
    ("artistic-1.0", "artistic-1.0", r"artistic licen[sc]e,? ?(?:version |v)?1(?:\.0)?", "artistic", ""),
    ("artistic-2.0", "artistic-2.0", r"artistic licen[sc]e,? ?(?:version |v)?2(?:\.0)?", "artistic", ""),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", "zlib", ""),
    ("libpng", "libpng(?:-2.0)?", r"libpng licen[sc]e", "libpng", ""),
    ("bsl-1.0", "bsl-1.0", r"boost software licen[sc]e", "boost", r"boost\.org/license_1_0"),
    ("busl-1.1", "busl-1.1", r"business source licen[sc]e", "business source", r"mariadb\.com/bsl11"),
    ("sspl-1.0", "sspl-1.0", r"server side public licen[sc]e", "server side public", ""),
    ("elastic-2.0", "elastic-2.0", r"elastic licen[sc]e", "elastic", r"elastic\.co/licensing"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"do what the f\w*k you want to public licen[sc]e|wtfpl", "do what the|wtfpl", r"wtfpl\.net"),
    ("cc0-1.0", "cc0-1.0", r"cc0(?: 1\.0)?(?: universal)?", "cc0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-pdm", "cc-pdm-1.0", r"public domain mark", "public domain mark", r"creativecommons\.org/publicdomain/mark"),
    ("ofl-1.1", "ofl-1.1", r"sil open font licen[sc]e", "open font", r"scripts\.sil\.org/ofl"),
    ("openssl", "openssl", r"openssl licen[sc]e", "openssl", ""),
    ("php-3.01", "php-3.0(?:1)?", r"php licen[sc]e", "php", r"php\.net/license"),
    ("python-2.0", "(?:python|psf)-2.0", r"python software foundation licen[sc]e|psf licen[sc]e", "python software|psf", ""),
    ("ruby", "ruby", r"ruby licen[sc]e", "ruby", ""),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql", ""),
    ("ncsa", "ncsa", r"university of illinois/ncsa open source licen[sc]e", "ncsa", ""),
    ("ms-pl", "ms-pl", r"microsoft public licen[sc]e", "microsoft", ""),
    ("ms-rl", "ms-rl", r"microsoft reciprocal licen[sc]e", "microsoft", ""),
    ("odbl-1.0", "odbl-1.0", r"open database licen[sc]e|odbl", "open database|odbl", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "odc-by-1.0", r"open data commons attribution licen[sc]e", "open data commons", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "pddl-1.0", r"public domain dedication and licen[sc]e", "public domain dedication", r"opendatacommons\.org/licenses/pddl"),
    ("ogl-uk", "ogl-uk-[123].0", r"open government licen[sc]e", "open government", r"nationalarchives\.gov\.uk/doc/open-government-licence"),
    ("openrail", "openrail", r"open ?rail(?:\+\+)?(?:-m)? licen[sc]e", "rail", ""),
    ("proprietary", "licenseref-proprietary", r"proprietary (?:software )?licen[sc]e", "proprietary", ""),
]

#: Parts a Creative Commons licence may add to "by", and its versions.
CC_PARTS = ("nc-nd", "nc-sa", "nc", "nd", "sa", "")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_WORDS = {"nc": "non-?commercial", "nd": "no-?deriv(?:ative)?s?(?: works)?", "sa": "share-?alike"}

# label, keyword, regular expression of a sentence that the licence's own text holds, priority.
SENTENCES = [
    ("mit", "free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software", 90),
    ("mit", "as is", r"the software is provided .as is., without warranty of any kind, express or implied", 60),
    ("isc", "with or without fee", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", 90),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification, are permitted", 85),
    ("bsd-3-clause", "neither the name", r"neither the names? of (?:(?!neither the name)[\s\S])+? may be used to endorse or promote products derived from", 88),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display", 92),
    ("apache-2.0", "you may not use this file", r"you may not use this file except in compliance with the licen[sc]e", 85),
    ("apache-2.0", "without warranties or conditions", r"without warranties or conditions of any kind, either express or implied", 60),
    ("gpl", "free software foundation", r"gnu general public licen[sc]e as published by the free software foundation", 82),
    ("gpl", "redistribute it", r"you can redistribute it and/or modify it under the terms of the gnu", 75),
    ("gpl-or-later", "any later version", r"either version \d(?:\.\d)? of the licen[sc]e, or \(at your option\) any later version", 78),
    ("lgpl", "lesser", r"gnu lesser general public licen[sc]e", 66),
    ("agpl", "affero", r"gnu affero general public licen[sc]e", 66),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e", 90),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 90),
    ("public-domain", "public domain", r"(?:released into|dedicated to|placed in|is in) the public domain", 55),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty", 88),
    ("bsl-1.0", "boost", r"boost software licen[sc]e - version 1\.0", 90),
    ("wtfpl", "you just do what", r"you just do what the f\w*k you want to", 90),
    ("cc", "creative commons", r"creative commons(?: [a-z-]+){0,4} licen[sc]e", 50),
    ("cc", "creativecommons.org", r"creativecommons\.org/licenses/", 45),
    ("reserved", "rights reserved", r"(?:all|some|no) rights reserved", 40),
    ("copyright", "copyright", r"copyright (?:\(c\)|\xc2\xa9)? ?(?:19|20)\d\d(?: ?[-,] ?(?:19|20)?\d\d)*", 30),
    ("copyright", "(c)", r"\(c\) (?:copyright )?(?:19|20)\d\d", 28),
    ("noncommercial", "commercial", r"(?:for|not for) (?:non-?commercial|commercial) use(?: only)?|non-?commercial (?:use|purposes) only", 42),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 58),
    ("proprietary", "without", r"may not be (?:reproduced|copied|distributed|republished)[^.]{0,80} without (?:the )?(?:prior |express |written )*(?:consent|permission)", 52),
    ("fair-use", "fair use", r"fair use (?:notice|doctrine|act)", 45),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public licen[sc]e,? version 1\.1", 90),
    ("cddl-1.0", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 90),
    ("epl-2.0", "accompanying materials", r"the accompanying materials are made available under the terms of the eclipse public licen[sc]e,? (?:v\.? ?|version )?2\.0", 90),
    ("epl-1.0", "accompanying materials", r"the accompanying materials are made available under the terms of the eclipse public licen[sc]e,? (?:v\.? ?|version )?1\.0", 90),
    ("ofl-1.1", "this font software", r"this font software is licen[sc]ed under the sil open font licen[sc]e", 90),
    ("cc0-1.0", "neighboring rights", r"waived all copyright and related or neighboring rights", 88),
    ("postgresql", "without a written agreement", r"for any purpose, without fee, and without a written agreement is hereby granted", 88),
    ("ncsa", "to deal with the software", r"to deal with the software without restriction", 86),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project", 88),
    ("php-3.01", "may not be called", r"products derived from this software may not be called .php.", 88),
    ("python-2.0", "psf is making python", r"psf is making python available to licen[sc]ee on an .as is. basis", 90),
    ("ruby", "at least one of the following", r"you may modify your copy of the software in any way, provided that you do at least one of the following", 84),
    ("odbl-1.0", "made available under", r"made available under the open database licen[sc]e", 86),
    ("pddl-1.0", "made available under", r"made available under the public domain dedication and licen[sc]e", 86),
    ("sspl-1.0", "mongodb", r"server side public licen[sc]e, version 1, as published by mongodb", 90),
    ("elastic-2.0", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service", 88),
    ("busl-1.1", "non-production use", r"make non-production use of the licen[sc]ed work", 88),
    ("ms-pl", "patent claim", r"if you bring a patent claim against any contributor over patents that you claim are infringed by the software", 84),
    ("ogl-uk", "public sector information", r"contains public sector information licen[sc]ed under the open government licen[sc]e", 90),
    ("openrail", "use-based restrictions", r"use-based restrictions (?:as set forth|referenced) in", 80),
    ("zlib", "plainly marked", r"altered source versions must be plainly marked as such", 88),
    ("bsl-1.0", "person or organization", r"free of charge, to any person or organization obtaining a copy of the software and accompanying documentation", 91),
    ("gfdl", "front-cover texts", r"with no invariant sections, no front-cover texts,? and no back-cover texts", 86),
    ("eupl", "under the eupl", r"licen[sc]ed under the eupl", 86),
    ("terms", "terms of use", r"subject to (?:the|our) terms of (?:use|service)", 35),
    ("terms", "terms of service", r"subject to (?:the|our) terms of service", 35),
]


@dataclass(frozen=True)
class Rule:
    """A signature: where ``keyword`` occurs, ``pattern`` is tried."""

    name: str
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern[bytes]
    priority: int
    score: float


def _compiled(pattern: str) -> re.Pattern[bytes]:
    spaced = re.sub(r"\[- \]", r"[-\\s]", pattern).replace(" ", r"\s+")
    # A blank made optional stays optional.
    spaced = spaced.replace(r"\s+?", r"\s*")
    return re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + spaced.encode("latin-1") + rb")(?![0-9a-z\x80-\xff])")


def rules() -> list[Rule]:
    """All signatures in their order: the table above, by the ways a licence is named."""
    found: list[Rule] = []

    def add(label: str, way: str, keywords: str, pattern: str, priority: int, score: float) -> None:
        number = sum(r.label == label and r.name.startswith(f"{label}/{way}") for r in found)
        name = f"{label}/{way}" + (f"-{number + 1}" if number else "")
        found.append(
            Rule(name, label, tuple(keywords.split("|")), _compiled(pattern), priority, score)
        )

    named = list(LICENSES)
    for parts in CC_PARTS:
        for version in CC_VERSIONS:
            label = "-".join(filter(None, ["cc-by", parts, version]))
            short = r"cc[- ]by" + "".join(f"[- ]{p}" for p in parts.split("-") if p)
            long = r"(?:creative commons )?attribution" + "".join(
                f"[- ]{CC_WORDS[p]}" for p in parts.split("-") if p
            )
            number = re.escape(version)
            named.append(
                (
                    label,
                    re.escape(label),
                    f"{short}[- ](?:version |v)?{number}|{long} {number}(?: international| unported| generic)?",
                    "cc|attribution",
                    rf"creativecommons\.org/licenses/{'-'.join(filter(None, ['by', parts]))}/{number}",
                )
            )
    for label, spdx, name, keyword, address in named:
        add(label, "tag", "spdx-license-identifier", rf"spdx-license-identifier: ?{spdx}", 100, 1.0)
        verbs = r"(?:licen[sc]ed|released|distributed|available|published|provided|redistributable)"
        add(
            label, "grant", keyword,
            rf"{verbs}(?: to you)? (?:under|with)(?: the)?(?: terms of(?: the)?)? (?:{name})", 80, 0.95,
        )
        add(label, "field", keyword, rf"licen[sc]e ?[:=] ?.?(?:{name})", 70, 0.85)
        # A Creative Commons name with its version says enough by itself.
        alone = name if label.startswith("cc-by") else rf"the (?:{name})|(?:{name}) licen[sc]e"
        add(label, "name", keyword, alone, 50, 0.7)
        if address:
            add(label, "address", address.split("\\")[0].split("/")[0], address, 75, 0.9)
    for label, keyword, pattern, priority in SENTENCES:
        add(label, "sentence", keyword, pattern, priority, priority / 100)
    return found


class Scanner:
    """All rules behind one automaton of their keywords."""

    def __init__(self) -> None:
        import ahocorasick

        self.rules = rules()
        behind: dict[str, list[int]] = {}
        for number, rule in enumerate(self.rules):
            for keyword in rule.keywords:
                behind.setdefault(keyword, []).append(number)
        self.keywords = ahocorasick.Automaton()
        for keyword, numbers in behind.items():
            self.keywords.add_word(keyword, tuple(numbers))
        self.keywords.make_automaton()
        self.base = []
        for phrase, label in BASE_PHRASES.items():
            words = [w.encode() for w in phrase.split()]
            self.base.append((label, re.compile(_GAP.join(words))))

    def detections(self, low: bytes) -> list[tuple[Rule, int, int]]:
        """Places of the signatures in a lower-cased text, overlaps resolved.

        Signatures are taken by priority, longer ones first among equals, then by
        place and by their order. One that lies inside a place already taken is
        suppressed.
        """
        # A rule's blank is any white space, so its keyword is looked up among single blanks.
        folded = b" ".join(low.split()).decode("latin-1")
        tried = {n for _, numbers in self.keywords.iter(folded) for n in numbers}
        levels: dict[int, list[tuple[int, int, int]]] = {}
        for number in tried:
            rule = self.rules[number]
            places = [(m.start(), -m.end(), number) for m in rule.pattern.finditer(low)]
            levels.setdefault(rule.priority, []).extend(places)
        kept: list[tuple[Rule, int, int]] = []
        above: list[tuple[list[int], list[int]]] = []
        for priority in sorted(levels, reverse=True):
            # By start, each with the furthest end so far: inside is one look-up a level.
            starts, ends, furthest = [], [], -1
            for start, minus_end, number in sorted(levels[priority]):
                end = -minus_end
                inside = end <= furthest or any(
                    reach[at - 1] >= end
                    for higher, reach in above
                    if (at := bisect_right(higher, start))
                )
                furthest = max(furthest, end)
                starts.append(start)
                ends.append(furthest)
                if not inside:
                    kept.append((self.rules[number], start, end))
            above.append((starts, ends))
        return sorted(kept, key=lambda k: (k[1], k[2], k[0].name))

    def base_places(self, low: bytes, mask: bytes) -> list[tuple[int, str]]:
        """(byte, label) of all places where a base phrase stands, word by word."""
        found = []
        for label, pattern in self.base:
            for match in pattern.finditer(low):
                start, end = match.span()
                if (start == 0 or not mask[start - 1]) and (end == len(mask) or not mask[end]):
                    found.append((start, label))
        return found


DETECTION = StructType(
    [
        StructField("label", StringType()),
        StructField("rule", StringType()),
        StructField("start", LongType()),
        StructField("end", LongType()),
        StructField("priority", IntegerType()),
        StructField("score", DoubleType()),
    ]
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices of every whole text.

    Columns doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, and ``detections``: the places left after overlaps are resolved, with
    start and end as bytes of the text in UTF-8. Labels are distinct, sorted and
    joined by commas; those of base phrases always stay. The score is the best
    of any detection, at least one half if a base phrase occurs, else 0.

    Only A-Z is lower-cased. A null text is empty: no words, labels '' and score
    0. Long texts are scanned whole, repeated rows each get a row, and extra
    columns are left behind.
    """
    shipped = docs.sparkSession.sparkContext.broadcast({})

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shipped.value
        scanner = kept.get("scanner") or kept.setdefault("scanner", Scanner())
        places = pa.list_(
            pa.struct(
                [("label", pa.string()), ("rule", pa.string()), ("start", pa.int64()),
                 ("end", pa.int64()), ("priority", pa.int32()), ("score", pa.float64())]
            )
        )
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                for values, value in zip(columns, _digest(scanner, text), strict=True):
                    values.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), places]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))],
                names=["doc_id", *NAMES],
            )

    rows = docs.select(column(id_col).alias("doc_id"), whole_text(text_col))
    kinds = [LongType()] * 4 + [StringType()] * 2 + [DoubleType(), ArrayType(DETECTION)]
    schema = StructType(
        [rows.schema.fields[0], *(StructField(n, k) for n, k in zip(NAMES, kinds, strict=True))]
    )
    return rows.mapInArrow(scanned, schema)


NAMES = (
    "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections",
)


def _digest(scanner: Scanner, text: bytes) -> tuple:
    low = text.translate(LOWER)
    mask = low.translate(IN_WORD)
    inside = np.frombuffer(mask, dtype=np.int8)
    starts = np.diff(inside, prepend=0) == 1
    base = scanner.base_places(low, mask)
    found = scanner.detections(low)
    first = last = None
    if base:
        word = np.cumsum(starts) - 1
        at = [int(word[place]) for place, _ in base]
        first, last = min(at), max(at)
    base_labels = {label for _, label in base}
    labels = base_labels | {rule.label for rule, _, _ in found}
    score = max([rule.score for rule, _, _ in found] + [0.5 if base else 0.0])
    return (
        int(starts.sum()), len(base), first, last,
        ",".join(sorted(base_labels)), ",".join(sorted(labels)), score,
        [
            {"label": r.label, "rule": r.name, "start": s, "end": e,
             "priority": r.priority, "score": r.score}
            for r, s, e in found
        ],
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of all documents, with their places."""
    return scan(table(spark, sf_dir, "documents"))
