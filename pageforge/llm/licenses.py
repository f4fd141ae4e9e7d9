"""License scans by ordered signature rules (operator 3).

Rules are regexes over lower-cased bytes.  Each has sets of words, one for each of its names; a rule runs only on texts
that hold all words of one of its sets, and only texts with one of the few gates get that far.  Gates are derived from
the sets: each set has a word that holds a gate.  Both are single words, as any run of non-words may stand between
words.  Rules come in order of priority; a detection that lies inside an accepted one of the same or a higher priority
is suppressed.  The phrases of `BASE` are always reported.

Words are runs of ASCII digits and letters and of all bytes above 127.  Null and empty texts have no words, no
detections, score 0.  Repeated rows give repeated rows, an empty table an empty one.  Of detections that lie in each
other the one of higher priority counts, then the longer one, then the rule that comes first.  Texts are scanned whole,
whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.llm.common import byte_view, pick, slices, table

BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Label (the public SPDX identifier), the license's names as words.
LICENSES = (
    ("apache-2.0", ("apache license version 2 0", "apache license v2", "apache 2 0", "apache software license version 2")),
    ("apache-1.1", ("apache license version 1 1", "apache software license version 1 1")),
    ("mit", ("mit license", "expat license", "mit x11 license")),
    ("mit-0", ("mit no attribution",)),
    ("bsd-2-clause", ("bsd 2 clause", "simplified bsd", "two clause bsd", "freebsd license")),
    ("bsd-3-clause", ("bsd 3 clause", "new bsd", "modified bsd", "three clause bsd", "revised bsd")),
    ("bsd-4-clause", ("bsd 4 clause", "original bsd", "four clause bsd")),
    ("0bsd", ("bsd zero clause", "zero clause bsd")),
    ("gpl-2.0", ("gnu general public license version 2", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gplv2", "gpl v2")),
    ("gpl-3.0", ("gnu general public license version 3", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gplv3", "gpl v3")),
    ("gpl-1.0", ("gnu general public license version 1", "gpl version 1", "gplv1")),
    ("lgpl-2.0", ("gnu library general public license", "lgpl version 2 0")),
    ("lgpl-2.1", ("gnu lesser general public license version 2 1", "lgpl version 2 1", "lgplv2 1", "lgpl v2 1")),
    ("lgpl-3.0", ("gnu lesser general public license version 3", "lgpl version 3", "lgplv3", "lgpl v3")),
    ("agpl-3.0", ("gnu affero general public license version 3", "agpl version 3", "agplv3", "agpl v3", "gnu affero general public license")),
    ("gfdl-1.3", ("gnu free documentation license",)),
    ("mpl-1.1", ("mozilla public license version 1 1", "mpl 1 1")),
    ("mpl-2.0", ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0")),
    ("epl-1.0", ("eclipse public license version 1 0", "eclipse public license v1 0")),
    ("epl-2.0", ("eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0")),
    ("cddl-1.0", ("common development and distribution license version 1 0", "common development and distribution license")),
    ("cpl-1.0", ("common public license version 1 0", "common public license")),
    ("cpal-1.0", ("common public attribution license",)),
    ("isc", ("isc license",)),
    ("zlib", ("zlib license", "zlib libpng license")),
    ("libpng-2.0", ("png reference library license", "libpng license")),
    ("bsl-1.0", ("boost software license version 1 0", "boost software license")),
    ("artistic-1.0", ("artistic license 1 0", "artistic license version 1 0")),
    ("artistic-2.0", ("artistic license 2 0", "artistic license version 2 0")),
    ("unlicense", ("the unlicense",)),
    ("wtfpl", ("do what the fuck you want to public license", "wtfpl")),
    ("python-2.0", ("python software foundation license", "psf license")),
    ("php-3.01", ("php license version 3 01", "php license")),
    ("ruby", ("ruby license",)),
    ("postgresql", ("postgresql license",)),
    ("openssl", ("openssl license",)),
    ("w3c", ("w3c software notice and license", "w3c license")),
    ("x11", ("x11 license",)),
    ("ncsa", ("university of illinois ncsa open source license", "ncsa open source license")),
    ("ofl-1.1", ("sil open font license version 1 1", "sil open font license", "open font license")),
    ("upl-1.0", ("universal permissive license",)),
    ("eupl-1.2", ("european union public licence", "european union public license", "eupl v1 2")),
    ("osl-3.0", ("open software license version 3 0", "open software license 3 0")),
    ("afl-3.0", ("academic free license version 3 0", "academic free license")),
    ("ms-pl", ("microsoft public license",)),
    ("ms-rl", ("microsoft reciprocal license",)),
    ("odbl-1.0", ("open database license", "odc open database license")),
    ("odc-by-1.0", ("open data commons attribution license",)),
    ("pddl-1.0", ("public domain dedication and license",)),
    ("cc0-1.0", ("cc0 1 0", "cc0 public domain dedication", "creative commons zero")),
    ("cc-by-4.0", ("cc by 4 0", "creative commons attribution 4 0")),
    ("cc-by-3.0", ("cc by 3 0", "creative commons attribution 3 0")),
    ("cc-by-2.0", ("cc by 2 0", "creative commons attribution 2 0")),
    ("cc-by-sa-4.0", ("cc by sa 4 0", "creative commons attribution sharealike 4 0", "creative commons attribution share alike 4 0")),
    ("cc-by-sa-3.0", ("cc by sa 3 0", "creative commons attribution sharealike 3 0", "creative commons attribution share alike 3 0")),
    ("cc-by-nc-4.0", ("cc by nc 4 0", "creative commons attribution noncommercial 4 0")),
    ("cc-by-nd-4.0", ("cc by nd 4 0", "creative commons attribution noderivatives 4 0")),
    ("cc-by-nc-sa-4.0", ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0")),
    ("cc-by-nc-nd-4.0", ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0")),
    ("cecill-2.1", ("cecill free software license", "cecill 2 1", "cecill license")),
    ("sspl-1.0", ("server side public license",)),
    ("busl-1.1", ("business source license 1 1", "business source license")),
    ("elastic-2.0", ("elastic license 2 0", "elastic license")),
    ("bigscience-openrail-m", ("bigscience openrail m", "responsible ai license")),
    ("vim", ("vim license",)),
    ("beerware", ("beer ware license", "beerware license")),
    ("ecl-2.0", ("educational community license",)),
    ("mulanpsl-2.0", ("mulan psl v2", "mulan permissive software license")),
    ("naumen", ("naumen public license",)),
    ("sleepycat", ("sleepycat license",)),
)

#: Whole notices: label, regex with a space for any run of non-words, words that it always holds, score.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted", 0.97),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "permission", 0.95),
    ("bsd-3-clause", "neither the name of [^.]{1,120} may be used to endorse or promote products", "neither the name", 0.93),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 0.85),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute license", 0.95),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 0.97),
    ("public-domain", "(?:placed|released|dedicated) (?:in|into|to) the public domain", "public domain", 0.8),
    ("proprietary", "all rights reserved worldwide", "all rights reserved", 0.5),
    ("cc-by-sa", "licensed under (?:a|the) creative commons attribution share ?alike", "licensed creative commons", 0.85),
    ("gpl-or-later", "gnu general public license (?:as published by the free software foundation )?(?:either )?version [123] (?:of the license )?or at your option any later version", "license later version", 0.98),
    ("apache-2.0", "you may not use this file except in compliance with the license", "compliance license", 0.9),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable license", 0.93),
    ("apache-2.0", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants", "patent license", 0.95),
    ("apache-1.1", "the end user documentation included with the redistribution if any must include the following acknowledg(?:e?ment)", "redistribution documentation", 0.85),
    ("gpl", "this program is free software you can redistribute it and or modify", "redistribute", 0.85),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", "distributed warranty", 0.85),
    ("gpl", "you should have received a copy of the gnu general public license along with", "gnu license", 0.95),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document", "verbatim license", 0.9),
    ("gpl-classpath", "as a special exception the copyright holders of this library give you permission to link this library with independent modules", "exception independent", 0.95),
    ("lgpl", "under the terms of the gnu (?:lesser|library) general public license", "gnu license", 0.95),
    ("lgpl", "this library is free software you can redistribute it and or modify", "redistribute library", 0.9),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license", "gnu license", 0.95),
    ("agpl", "under the terms of the gnu affero general public license", "affero", 0.97),
    ("agpl", "you should have received a copy of the gnu affero general public license", "affero", 0.97),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "documentation license", 0.97),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial permission", 0.93),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "noninfringement", 0.9),
    ("x11", "except as contained in this notice the name of [^.]{1,120} shall not be used in advertising or otherwise to promote the sale", "advertising notice", 0.93),
    ("json", "the software shall be used for good not evil", "evil", 0.97),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions", 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions", 0.9),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e?ment)", "advertising", 0.95),
    ("bsd", "this software is provided by the (?:copyright holders?|regents|authors?) and contributors as is", "contributors", 0.88),
    ("isc", "the software is provided as is and the authors? disclaims? all warranties with regard to this software", "warranties regard", 0.9),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "warranty liable", 0.95),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "misrepresented", 0.95),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "organization hereby", 0.97),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla", 0.97),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version", "mozilla", 0.95),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl", 0.95),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse", 0.97),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "common development", 0.97),
    ("cpl-1.0", "this program and the accompanying materials are made available under the terms of the common public license", "common accompanying", 0.95),
    ("artistic", "you may copy and distribute verbatim copies of the (?:standard version|source form of the standard version) of (?:the|this) package", "verbatim package", 0.9),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "written agreement", 0.97),
    ("hpnd", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", "sell hereby", 0.95),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", "documentation hereby", 0.93),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl", 0.95),
    ("python-2.0", "this license agreement is between the python software foundation", "python foundation", 0.97),
    ("ofl", "this font software is licensed under the sil open font license", "font license", 0.97),
    ("ofl", "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself", "typefaces", 0.9),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", "governs license", 0.9),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal with the software without restriction", "hereby restriction", 0.93),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone compile", 0.95),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain", "jurisdictions", 0.95),
    ("cc0-1.0", "to the extent possible under law [^.]{1,120} has waived all copyright and related or neighboring rights", "waived", 0.97),
    ("cc-by", "this work is licensed under (?:a|the) creative commons attribution (?:[0-9] [0-9] )?(?:international |unported |generic )?licen[cs]e", "creative commons", 0.95),
    ("cc-by-nc", "licensed under (?:a|the) creative commons attribution non ?commercial", "creative commons", 0.9),
    ("cc-by-nd", "licensed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s", "creative commons", 0.9),
    ("wtfpl", "you just do what the fuck you want to", "fuck", 0.97),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", "beer", 0.97),
    ("public-domain", "this (?:work|file|software|code|program) is (?:hereby )?in the public domain", "public domain", 0.9),
    ("public-domain", "the authors? disclaims? copyright to this source code", "copyright source", 0.9),
    ("public-domain", "no copyright is claimed", "copyright claimed", 0.6),
    ("sspl", "making the functionality of the program or modified version available to third parties as a service", "functionality service", 0.95),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "licensor production", 0.97),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service", "hosted managed", 0.97),
    ("commons-clause", "the software is provided to you by the licensor under the license as defined below subject to the following condition", "licensor license", 0.95),
    ("openrail", "you agree not to use the model or derivatives of the model", "derivatives model", 0.9),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized prohibited", 0.9),
    ("proprietary", "proprietary and confidential", "proprietary confidential", 0.7),
    ("proprietary", "no part of this (?:publication|book|document|work) may be reproduced", "reproduced", 0.85),
    ("proprietary", "may not be reproduced distributed or transmitted in any form or by any means", "reproduced transmitted", 0.85),
)

#: How a name is put to use: the form around it, its priority (smaller goes first) and its score.
FORMS = (
    ("(?:licen[cs]ed|released|distributed|published|available|provided) under (?:the |a )?(?:terms of (?:the )?)?{}", 1, 0.95),
    ("(?:see|subject to|governed by|covered by|according to) (?:the )?{}", 2, 0.85),
    ("{}", 3, 0.7),
)

_CC_BY = re.compile(rb"cc[\x00-\x2f\x3a-\x60\x7b-\x7f]+by(?![^\x00-\x2f\x3a-\x60\x7b-\x7f])")
GAP = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]"
WORD = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]"


def _regex(words: str) -> re.Pattern:
    return re.compile((rf"(?<!{WORD})(?:" + words.replace(" ", f"{GAP}+") + rf")(?!{WORD})").encode())


def _words(*names: str) -> tuple[frozenset[bytes], ...]:
    """The sets of words of which a text must hold one whole set."""
    return tuple(frozenset(name.encode().split()) for name in names)


def build_rules() -> list[tuple[int, str, str, re.Pattern, tuple[frozenset[bytes], ...], float]]:
    """(priority, label, rule name, regex, sets of words, score), in the order in which they apply."""
    rules = []
    for k, (label, text, key, score) in enumerate(NOTICES):
        rules.append((0, label, f"notice{k}:{label}", _regex(text), _words(key), score))
    for label, names in LICENSES:
        own = re.escape(label).replace(r"\-", "-")
        spdx = rf"spdx-license-identifier:[\x20\x09(]*{own}(?:-only|-or-later|\+)?(?![-.\w])"
        rules.append((0, label, f"spdx:{label}", re.compile(spdx.encode()), _words("spdx license identifier"), 1.0))
        link = rf"(?:spdx\.org/licenses|opensource\.org/licen[cs]es?)/{own}(?![-.\w])"
        rules.append((1, label, f"link:{label}", re.compile(link.encode()), _words("spdx licenses", "opensource licenses", "opensource licences"), 0.9))
        for form, priority, score in FORMS:
            some = "(?:" + "|".join(sorted(names, key=lambda n: (-len(n), n))) + ")"
            rules.append((priority, label, f"name{priority}:{label}", _regex(form.format(some)), _words(*names), score))
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            link = rf"creativecommons\.org/licenses/{kind}/{re.escape(version)}"
            rules.append((0, f"cc-{kind}-{version}", f"link:cc-{kind}-{version}", re.compile(link.encode()), _words("creativecommons licenses"), 0.98))
    return sorted(rules, key=lambda r: r[0])


def build_gates(needs: set[frozenset[bytes]]) -> list[bytes]:
    """Few parts of words, of which each set of words holds one: those that most sets hold first, long ones before short ones.

    Sets with `cc` and `by` have a gate of their own, as their words are too short.
    """
    gates, left = [b"licen"], {s for s in needs if not {b"cc", b"by"} <= s}
    while left := {s for s in left if not any(gates[-1] in w for w in s)}:
        some = sorted({w for s in left for w in s if len(w) > 2})
        gates.append(max(some, key=lambda g: (sum(any(g in w for w in s) for s in left), len(g))))
    return gates


RULES = build_rules()
GATES = build_gates({s for r in RULES for s in r[4]} | set(_words(*(phrase for phrase, _ in BASE))))
_KEYS = sorted({w for r in RULES for s in r[4] for w in s})
_BASE = [(label, _regex(phrase)) for phrase, label in BASE]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[: 0x30] = _IS_WORD[0x3A : 0x61] = _IS_WORD[0x7B : 0x80] = False


def detect(text: bytes) -> list[tuple[int, int, str, str, float]]:
    """Accepted detections (start, end, label, rule, score) of a lower-cased text, in order of start."""
    found = []
    held = {w for w in _KEYS if w in text}
    for order, (priority, label, name, regex, keys, score) in enumerate(RULES):
        if any(s <= held for s in keys):
            found += [(priority, m.start() - m.end(), order, m.start(), m.end(), label, name, score) for m in regex.finditer(text)]
    accepted: list[tuple[int, int, str, str, float]] = []
    starts: list[tuple[int, int]] = []  # accepted intervals that lie in no other, so both ends ascend
    for _, _, _, a, b, label, name, score in sorted(found):
        k = _place(starts, a)
        if k >= 0 and starts[k][1] >= b:
            continue
        accepted.append((a, b, label, name, score))
        z = k + 1
        while z < len(starts) and starts[z][1] <= b:
            z += 1
        starts[k + 1 : z] = [(a, b)]
    return sorted(accepted)


def _place(rows: list[tuple[int, int]], a: int) -> int:
    """The last interval that starts at or before `a`."""
    from bisect import bisect_right

    return bisect_right(rows, a, key=lambda r: r[0]) - 1


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("score", pa.float64())])
SCHEMA = "doc_id long, n_words long, base array<struct<word:long,label:string>>, found array<struct<start:long,end:long,label:string,rule:string,score:double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, off = byte_view(part.column("text"))
            low = _LOWER[data]
            word = _IS_WORD[low]
            start = word.copy()
            start[1:] &= ~word[:-1]
            inner = off[:-1][off[:-1] < len(low)]
            start[inner] = word[inner]
            seen = np.zeros(len(low) + 1, np.int64)
            np.cumsum(start, out=seen[1:])
            raw = low.tobytes()
            hit: set[int] = set()
            places = []
            for gate in GATES:
                at = raw.find(gate)
                while at >= 0:
                    places.append(at)
                    at = raw.find(gate, at + len(gate))
            places += [m.start() for m in _CC_BY.finditer(raw)]
            hit.update((np.searchsorted(off, np.array(places, np.int64), side="right") - 1).tolist())
            base: list[list] = [[] for _ in range(part.num_rows)]
            found: list[list] = [[] for _ in range(part.num_rows)]
            for i in hit:
                a, b = int(off[i]), int(off[i + 1])
                text = raw[a:b]
                base[i] = [{"word": int(seen[a + m.start()] - seen[a]), "label": label} for label, regex in _BASE for m in regex.finditer(text)]
                chars = np.zeros(0)
                for s, e, label, rule, score in detect(text):
                    if not len(chars):  # places in code points
                        chars = np.concatenate([[0], np.cumsum((low[a:b] & 0xC0) != 0x80)])
                    found[i].append({"start": int(chars[s]), "end": int(chars[e]), "label": label, "rule": rule, "score": score})
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(seen[off[1:]] - seen[off[:-1]]),
                    pa.array(base, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                    pa.array(found, pa.list_(SPAN)),
                ],
                ["doc_id", "n_words", "base", "found"],
            )


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, base (places of the base phrases, by word) and found (accepted detections, by code point)."""
    return pick(df, doc_id=doc_id, text=text).mapInArrow(_scan, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    joined = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    base, own = F.transform("base", lambda x: x["label"]), F.transform("found", lambda x: x["label"])
    best = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.6).otherwise(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        best.alias("score"),
        F.size("found").cast("long").alias("n_found"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))
