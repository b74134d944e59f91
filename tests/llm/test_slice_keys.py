"""Keys of many texts at once against the smallest shingle of every paragraph, paragraph by paragraph."""

import numpy as np

from panelcast.llm import passages
from panelcast.llm.words import mix, shingle_hashes


def plain(word, min_words):
    found = set()
    if len(word) >= max(min_words, passages.WINDOW):
        shingle, context = shingle_hashes(word, passages.SHINGLE), shingle_hashes(word, passages.CONTEXT)
        for band in range(passages.BANDS):
            h = mix(shingle + np.uint64(band * 0x51ED270B9F3A6C15 & (1 << 64) - 1))
            windows = np.lib.stride_tricks.sliding_window_view(h, passages.WINDOW - passages.SHINGLE + 1)
            for at in np.unique(np.arange(len(windows)) + windows.argmin(axis=1)):
                if at < len(context):
                    found.add((int(mix(context[at : at + 1] + np.uint64(band)).view(np.int64)[0]), int(at)))
    return found


def test_keys_of_a_slice_are_those_of_every_text():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 50, n) for n in (0, 3, 39, 40, 49, 50, 51, 400, 0, 75)]
    texts += [np.arange(300) % p for p in (1, 2, 7, 20, 35, 36, 37, 60)] + [rng.integers(0, 2, 500), texts[7], texts[7]]
    words = [mix(t.astype(np.uint64) + np.uint64(9)) for t in texts]
    cuts = np.r_[0, np.cumsum([len(w) for w in words])]
    row, key, first, last = passages.slice_keys(np.concatenate(words), cuts, 50)
    assert (np.diff(row) >= 0).all()
    for i, w in enumerate(words):
        want = plain(w, 50)
        own = [(int(k), int(a), int(b)) for r, k, a, b in zip(row, key, first, last) if r == i]
        ends = {(k, a) for k, a, _ in own} | {(k, b) for k, _, b in own}
        assert ends <= want and {k for k, _ in want} == {k for k, _, _ in own}, i
        assert all(any(k == c and a <= p <= b for c, a, b in own) for k, p in want), i
