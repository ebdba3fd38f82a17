import re

import numpy as np
import pyarrow as pa
import pytest


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 20])
def test_words_and_hashes_do_not_depend_on_blocks(block, monkeypatch):
    from boxwright.llm import textscan

    texts = ["Ab  cd\tef", "", None, "x" * 150 + " y", "ab cd", "é à" * 20, " ", "end"]
    whole = textscan.scan(pa.array(texts), textscan.space_separated()).hashes()
    monkeypatch.setattr(textscan, "BLOCK", block)
    words = textscan.scan(pa.array(texts), textscan.space_separated())
    found = [bytes(words.data[a:b]).decode() for a, b in zip(words.start, words.stop, strict=True)]
    low = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    assert found == [w for t in low for w in t]
    assert np.diff(words.ptr).tolist() == [len(t) for t in low]
    got = words.hashes()
    assert (got == whole).all()
    assert len(set(got.tolist())) == len(set(found)) and all(len({h for h, w in zip(got.tolist(), found) if w == x}) == 1 for x in found)


def test_a_text_of_200_mb_is_scanned_in_bounded_memory():
    import resource

    from boxwright.llm import textscan

    texts = pa.array([b"some longer words in a text " * 7_500_000], pa.binary()).cast(pa.large_string())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    words = textscan.scan(texts, textscan.space_separated())
    assert len(words.hashes()) == 6 * 7_500_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 2_800_000  # 210 MB of text, 45 million words of 24 bytes, and the joining of their parts
