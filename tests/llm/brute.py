"""Brute-force helpers that several tests share."""

import re
import zlib

import numpy as np
from tokenizers import Tokenizer

from tidings.llm.queries import tokenizer


def split(text):
    lower = re.sub("[A-Z]", lambda found: found[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text, size=5):
    words = split(text)
    return {tuple(words[at : at + size]) for at in range(max(len(words) - size + 1, min(len(words), 1)))}


def encoded(name, texts, end):
    found = Tokenizer.from_file(tokenizer(name))
    return [one.ids + [end] for one in found.encode_batch([text or "" for text in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def ordered(rows):
    return sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or ""))


def brute_components(rows, percent):
    sets, root = {}, {}
    for one, text in rows:
        if one is not None:
            sets[one] = shingles(text) | sets.get(one, set())
            root[one] = one

    def of(one):
        while root[one] != one:
            one = root[one]
        return one

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((of(a), of(b)))
                root[high] = low
    return {one: (len(sets[one]), of(one)) for one in sets}
