"""Ids of many texts at once for a lower-casing word-level BPE file of the `tokenizers` library.

White space is dropped and neither normalizer nor word pattern looks across it, so
the runs between white space encode alone. A batch encodes its distinct runs only:
they are normalized and cut into words, and the pairs of all distinct words are merged
together, one merge rule a word and round, by numpy. Words of over LONG bytes, and
texts with special strings or separators that the pattern does not count as white
space, go through the library. Nothing is kept between batches but the merge table.
"""
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

LONG = 64  # bytes of a word beyond which rounds of merges would be many
_models = {}
# Fixed value: the word pattern of the tokenizer file.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")


def _byte_chars():
    """The character that stands for each byte: itself where it prints, else the next free one from 256."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(prints))}
    return [chr(rest.get(b, b)) for b in range(256)]


def _spread(starts, lengths):
    """Indices of the concatenated ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class WordBpe:
    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        if len(vocab) > 1 << 16:
            raise ValueError("ids above 16 bits")
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = "(?i)" + "|".join([r"[\x1c-\x1f]", *special])
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.pairs = pa.array(np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first = np.array([vocab[c] for c in _byte_chars()], np.int64)
        self.last = np.array([vocab[c + "</w>"] for c in _byte_chars()], np.int64)

    def whole(self, text):
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint16)

    def _merge(self, data, offsets):
        """(ids, lengths) of words of at most LONG bytes, in order."""
        n = len(offsets) - 1
        sym = self.first[data]
        sym[offsets[1:] - 1] = self.last[data[offsets[1:] - 1]]
        size = np.diff(offsets)
        alive = np.arange(n)
        done, done_size, done_word = [], [], []
        while len(alive):
            ends = np.cumsum(size)
            starts = ends - size
            key = np.empty(len(sym), np.int64)
            key[:-1] = sym[:-1] << 16 | sym[1:]
            key[ends - 1] = -1
            rank = pc.index_in(pa.array(key), value_set=self.pairs).fill_null(len(self.made)).to_numpy(zero_copy_only=False)
            best = np.minimum.reduceat(rank, starts)
            over = best == len(self.made)
            hit = (rank == np.repeat(best, size)) & (rank < len(self.made))
            if over.any():
                done.append(sym[_spread(starts[over], size[over])])
                done_size.append(size[over])
                done_word.append(alive[over])
            at = np.flatnonzero(hit)
            if len(at) > 1:  # of hits in a row every other one merges
                head = np.concatenate([[True], np.diff(at) != 1])
                lead = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - lead) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            keep &= np.repeat(~over, size)
            left = np.add.reduceat(keep, starts, dtype=np.int64)
            sym, size, alive = sym[keep], left[~over], alive[~over]
        if not done:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        ids, sizes, words = np.concatenate(done), np.concatenate(done_size), np.concatenate(done_word)
        order = np.argsort(words, kind="stable")
        starts = np.cumsum(sizes) - sizes
        return ids[_spread(starts[order], sizes[order])].astype(np.uint16), sizes[order]

    def _words(self, words):
        """(ids, lengths) of distinct words, a string array without empty ones."""
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        long = np.flatnonzero(lengths > LONG)
        short = words if not len(long) else words.filter(pa.array(lengths <= LONG))
        data = np.frombuffer("".join(short.to_pylist()).encode(), np.uint8)
        ids, sizes = self._merge(data, np.concatenate([[0], np.cumsum(lengths[lengths <= LONG])]))
        if len(long):
            own = {k: self.whole(words[k].as_py()) for k in long.tolist()}
            ends = np.cumsum(sizes)
            parts, every, k = [], np.zeros(len(words), np.int64), 0
            for w in range(len(words)):
                if w in own:
                    parts.append(own[w])
                else:
                    parts.append(ids[ends[k] - sizes[k]:ends[k]])
                    k += 1
                every[w] = len(parts[-1])
            ids, sizes = np.concatenate(parts), every
        return ids, sizes

    def _runs(self, runs):
        """(ids, starts, lengths) of distinct runs; None if the normalizer does not keep them apart."""
        if not len(runs):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
        latin = pc.match_substring_regex(runs, r"^[\x00-\x{ff}]*$").to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(latin), np.flatnonzero(~latin)])
        line = "\n".join(runs.filter(pa.array(latin)).to_pylist()).lower()  # of Latin-1 the normalizer only lowers letters
        if not latin.all():
            rest = self.tok.normalizer.normalize_str("\n".join(runs.filter(pa.array(~latin)).to_pylist())).replace(" ", "\n")
            line = f"{line}\n{rest}" if latin.any() else rest
        found = pa.array(_WORDS.findall(line + "\n"), pa.string()).dictionary_encode()
        codes, words = found.indices.to_numpy(), found.dictionary
        feed = pc.index(words, "\n").as_py()
        ids, sizes = self._words(words.filter(pc.not_equal(words, "\n")))
        sizes = np.insert(sizes, feed, 0)
        starts = np.cumsum(sizes) - sizes
        ends = np.flatnonzero(codes == feed)
        if len(ends) != len(runs):
            return None
        own = sizes[codes]
        total = np.concatenate([[0], np.cumsum(own)])
        bounds = np.concatenate([[0], total[ends + 1]])
        at, lengths = np.empty(len(runs), np.int64), np.empty(len(runs), np.int64)
        at[order], lengths[order] = bounds[:-1], np.diff(bounds)
        return ids[_spread(starts[codes], own)], at, lengths

    def encode(self, texts, end):
        """(ids, offsets) of a string array without nulls: each text's ids and then `end`."""
        odd = pc.match_substring_regex(texts, self.odd)
        plain = pc.if_else(odd, "", texts)
        split = pc.utf8_split_whitespace(plain)
        bounds, runs = split.offsets.to_numpy().astype(np.int64), split.values.dictionary_encode()
        codes, filled = runs.indices.to_numpy().astype(np.int64), pc.not_equal(runs.dictionary, "")
        got = self._runs(runs.dictionary.filter(filled))
        if got is None:
            odd = pa.array(np.ones(len(texts), bool))
            got = (np.zeros(0, np.uint16), *[np.zeros(pc.sum(filled).as_py(), np.int64)] * 2)
        ids, starts, sizes = got[0], *(np.zeros(len(runs.dictionary), np.int64) for _ in range(2))
        starts[filled.to_numpy(zero_copy_only=False)], sizes[filled.to_numpy(zero_copy_only=False)] = got[1], got[2]
        ids, sizes, starts = np.append(ids, np.uint16(end)), np.append(sizes, 1), np.append(starts, len(ids))
        codes = np.insert(codes[bounds[0]:bounds[-1]], bounds[1:] - bounds[0], len(sizes) - 1)
        own = sizes[codes]
        flat = ids[_spread(starts[codes], own)]
        total = np.concatenate([[0], np.cumsum(own)])
        offsets = total[np.concatenate([[0], bounds[1:] - bounds[0] + np.arange(1, len(texts) + 1)])]
        if pc.any(odd).as_py():
            parts = [np.append(self.whole(t.as_py()), np.uint16(end)) if o else flat[a:z] for o, t, a, z in zip(odd.to_pylist(), texts, offsets[:-1], offsets[1:])]
            flat, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return flat, offsets


def model(path) -> WordBpe:
    if path not in _models:
        _models[path] = WordBpe(path)
    return _models[path]
