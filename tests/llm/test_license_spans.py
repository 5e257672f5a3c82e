"""The licence scan against a plain one: every rule without its gate, spans dropped one against all others."""

from __future__ import annotations

import random
import re

from millrace.llm import licenses

FRAGMENTS = (
    "Licensed under the Apache License, Version 2.0.", "Apache 2.0", "SPDX-License-Identifier: MIT OR Apache-2.0", "MIT License", "the mit license applies",
    "released under CC BY 4.0", "CC BY-SA 4.0", "cc by", "GNU General Public License, version 3", "general public license", "GNU Lesser General Public License v2.1",
    "All rights reserved.", "BSD 3-Clause License", "Mozilla Public License 2.0", "dual licensed under the MIT license and the Apache license", "https://www.apache.org/licenses/LICENSE-2.0",
    "https://opensource.org/licenses/MIT", "This is free and unencumbered software released into the public domain.", "ISC license", "Redistribution and use in source and binary forms,",
    "with or without modification, are permitted provided that the following conditions are met:", "Neither the name of", "the names OpenSSL Toolkit and OpenSSL Project must not be used",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal",
    "in the Software without restriction, including", "furnished to do so, subject to", "Except as contained in this notice, the name of", "with the Software without restriction",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3",
    "", "\n", "a word", "not licensed", "version 2.0", "or later", "İ Kelvin K",
)


def plain(text: str) -> tuple[str, float]:
    joined = f" {re.sub(r'[\x00-/:-`{-\x7f]+', ' ', text.lower()).strip()} "
    spans = []
    for r in licenses.rules():
        spans += [(m.start(), m.end(), r["priority"], r["id"], r["label"]) for m in re.finditer(r["regex"], joined)]

    def hidden(x, y) -> bool:
        """y covers x, with no lower priority; equal spans hide those that come later."""
        if x is y or not (y[0] <= x[0] and x[1] <= y[1] and y[2] >= x[2]):
            return False
        return (y[0], -y[1], -y[2], y[3]) < (x[0], -x[1], -x[2], x[3])

    kept = [x for x in spans if not any(hidden(x, y) for y in spans)]
    base = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in joined}
    best = max([x[2] for x in kept], default=0)
    return ",".join(sorted(base | {x[4] for x in kept})), max(best, 40 if base else 0) / 100


def test_labels_and_scores_match_a_plain_scan(spark):
    rng = random.Random(11)
    texts = [rng.choice((" ", ", ", "\n", " and ")).join(rng.choices(FRAGMENTS, k=rng.randrange(1, 9))) for _ in range(400)]
    texts += [*FRAGMENTS, " ".join(FRAGMENTS), "word " * 3000 + "MIT License"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(rows).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert len({x for x, _ in got.values()}) > 50
