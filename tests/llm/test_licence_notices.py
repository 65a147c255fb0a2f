"""Several notices in one paragraph, and notices wrapped over lines."""

import random
import textwrap

import pyarrow as pa
import pytest

from trapwise.llm import licenses


class Sent:
    """A model as a broadcast variable holds it."""

    def __init__(self, value):
        self.value = value


@pytest.fixture(scope="module")
def scan():
    rng = random.Random(6)
    filler = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(40)) for _ in range(400)]
    kernel = licenses._scan_kernel(Sent(licenses.fit(filler)))

    def run(*texts):
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": list(texts)})
        return [r for b in kernel(iter([batch])) for r in b.to_pylist()]

    run.filler = filler
    return run


def test_every_notice_of_a_line_counts(scan):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    texts = [f"{mit} Some words between them. {apache}", "Licensed under the Apache License, Version 2.0 or the MIT License.",
             f"{mit} {scan.filler[1]} {scan.filler[2]} {apache} {scan.filler[3]} Licensed under CC BY-NC 4.0."]
    got = scan(*texts)
    assert [r["families"] for r in got] == ["Apache-2.0,MIT", "Apache-2.0,MIT", "Apache-2.0,CC-BY-NC,MIT"]
    assert [r["n_licences"] for r in got] == [2, 2, 3]


def test_related_families_are_told_apart(scan):
    every = [(f, t) for f, texts in licenses.TEMPLATES.items() for t in texts]
    lesser = "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"
    got = scan(*(t for _, t in every), lesser)
    assert [r["families"] for r in got] == [f for f, _ in every] + ["LGPL"]


WRAPPED = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
           "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
           "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "dnl ", '.\\" '])
@pytest.mark.parametrize("columns", [35, 70, 80])
def test_wrapped_notices(scan, columns, mark):
    wrapped = {f: "\n".join(mark + x for x in textwrap.wrap(t, columns - len(mark))) for f, t in WRAPPED.items()}
    blank = f"\n{mark.rstrip()}\n"
    got = scan(*wrapped.values(), blank.join(["int x = 1;", *wrapped.values(), scan.filler[5]]), None, "", "\n\n")
    assert [r["families"] for r in got] == [*wrapped, "BSD,GPL,MIT", None, None, None]
    assert [r["n_licences"] for r in got] == [1, 1, 1, 3, 0, 0, 0]
    assert [r["n_paragraphs"] for r in got[-3:]] == [0, 0, 0]
