"""Licence sentences wrapped over any number of lines."""

import textwrap

import pytest

from lexigrain.llm.licenses import SENTENCES, Scanner

NOTICE = [SENTENCES[k][0] for k in ("mit-grant", "mit-condition", "warranty-as-is")]
IDS = ["mit-grant", "mit-condition", "warranty-as-is"]


@pytest.mark.parametrize("width", [20, 40, 60, 72, 2000])
@pytest.mark.parametrize("mark", ["// ", " * ", ""])
def test_a_wrapped_licence_is_found(width, mark):
    text = "\n".join(mark + line for s in NOTICE for line in [*textwrap.wrap(s + ".", width), ""])
    scanner = Scanner()
    assert scanner.sentences("code();\n" + text + "\nmore();") == IDS
    assert scanner.licences(IDS) == ["MIT"]


def test_node_header():
    text = """// Permission is hereby granted, free of charge, to any person obtaining a
// copy of this software and associated documentation files (the
// "Software"), to deal in the Software without restriction, including
// without limitation the rights to use, copy, modify, merge, publish,
// distribute, sublicense, and/or sell copies of the Software, and to permit
// persons to whom the Software is furnished to do so, subject to the
// following conditions:
//
// The above copyright notice and this permission notice shall be included
// in all copies or substantial portions of the Software.
"""
    assert Scanner().sentences(text) == IDS[:2]


def test_far_apart_and_broken_sentences():
    grant = NOTICE[0].replace(" ", "\n" * 40)
    assert Scanner().sentences(grant + "\n") == ["mit-grant"]
    assert Scanner().sentences(NOTICE[0].replace("merge, ", "")) == []


@pytest.mark.parametrize("width", [40, 72, 100])
@pytest.mark.parametrize("holder", ["the copyright holder", "Foo Bar Ltd. and Sons", "the University of Somewhere nor of its\nDepartment of Things"])
def test_a_holder_is_a_name(width, holder):
    text = "\n".join(line for k in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")
                     for line in [*textwrap.wrap(SENTENCES[k][0].replace("*", holder) + ":", width), ""])
    scanner = Scanner()
    assert scanner.licences(scanner.sentences(text)) == ["BSD-3-Clause"]
    assert scanner.sentences(SENTENCES["bsd-endorse"][0].replace("*", f"{holder} " * 20)) == []


@pytest.mark.parametrize("ids, name", [
    (("gpl-free-software", "gpl-redistribute-3"), "GPL-3.0-or-later"), (("gpl-free-software", "gpl-redistribute-2"), "GPL-2.0-or-later"),
    (("library-free-software", "lgpl-redistribute-21"), "LGPL-2.1-or-later"), (("gpl-free-software", "agpl-redistribute-3"), "AGPL-3.0-or-later"),
    (("isc-grant",), "ISC"), (("zlib-as-is", "zlib-grant"), "Zlib"), (("unlicense-notice",), "Unlicense"), (("epl-2-notice",), "EPL-2.0")])
def test_usual_licences(ids, name):
    scanner = Scanner()
    assert scanner.sentences("; ".join(SENTENCES[i][-1] for i in ids)) == list(ids) and scanner.licences(list(ids)) == [name]


def test_every_sentence_is_found_in_each_form_and_the_longest_wins():
    scanner = Scanner()
    for k, forms in SENTENCES.items():
        for form in forms:
            assert scanner.sentences(f"some words. {form.replace('*', 'somebody').upper()} and more") == [k]
    nested = Scanner({"short": ["a b c"], "long": ["a b c d"], "named": ["a b * z"]}, [])
    texts = ["a b c d", "a b c x", "a b q r z", "a b c d z", "a b z", "a b"]
    assert [nested.sentences(t) for t in texts] == [["long"], ["short"], ["named"], ["named"], [], []]


def test_many_beginnings_take_seconds():
    import time

    began = time.perf_counter()
    assert Scanner().sentences("neither the name of x y z " * 20_000) == []
    assert time.perf_counter() - began < 20
