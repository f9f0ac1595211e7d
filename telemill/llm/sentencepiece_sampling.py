"""SentencePiece encoding and decoding, and distinct sampled segmentations by Gumbel top-k.

Encoding follows the given model.  Sampling draws k segmentations without replacement from the model's lattice
(every way to spell the text in pieces; a piece of rank r weighs 1 / (r + 2)), with a whole text as one row:

* backward sums over the lattice make each choice of a next piece a conditional probability, so a path is a
  chain of choices and its log-probability a sum;
* the search is A-star on Gumbel-perturbed log-probabilities.  A node of the agenda is a prefix of a path with
  the choices already taken at its end excluded; its priority is the largest perturbed log-probability below it,
  drawn as a Gumbel variable cut off at its parent's.  Popping a node completes it to a path, so the k-th pop is
  the k-th largest perturbed path, and no path comes twice;
* the priority of the next node left on the agenda is the threshold that gives each sample its inclusion
  probability 1 - exp(-exp(log_prob - threshold)), given as its logarithm.

Uniform numbers are hashes of (row key, sample, place), so a row gives the same samples in any partition.
Pieces never cross from letters into a space, so the lattice is a chain of the lattices of the text's units
(spaces and what follows them); the distinct units of some texts are worked out together with numpy.

Defined cases: a null text counts as empty; an empty text has no pieces and one segmentation; a text with fewer
than k segmentations gives them all, each with log_inclusion 0; equal keys and texts give equal samples.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import text_of
from telemill.llm.shingles import chunks, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_UNIT = re.compile(" +[^ ]*")
_B = np.uint64(0x9E3779B97F4A7C15)
#: Characters worked on together, rows of a batch made text at a time and ids of units kept: what bounds a
#: worker's memory.
_CHUNK, _ROWS, _KEEP = 1 << 18, 500, 1 << 18


class _Seen(dict):
    """Numbers what it is asked for in order of first appearance; ``fresh`` is what was new."""

    fresh: list[str]

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


def _uniform(*parts: np.ndarray) -> np.ndarray:
    """In (0, 1), from a hash of the parts."""
    h = np.uint64(0)
    for p in parts:
        h = mix(h * _B + p)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Codec:
    """Encoder, decoder and sampler of one model, given as bytes.

    Units once met are kept, with their ids and lattices, in a table of up to ``keep`` ids; the units of some
    texts that it has no room for stay until the next texts.
    """

    _KINDS = {
        "unit": {"unit_at": np.int64, "unit_len": np.int64, "id_at": np.int64, "id_n": np.int64},
        "id": {"unit_ids": np.int32},
        "place": {"chars": np.uint32, "bytes_here": np.int8, "first": np.int32, "degree": np.int8},
        "edge": {"cum": np.float32, "log_prob": np.float64, "log_rest": np.float32, "size": np.int8, "piece": np.int32},
    }

    def __init__(self, model: bytes, keep: int = _KEEP):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = [k for k in range(n) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        self.byte_id = np.zeros(256, np.int32)
        spelt = [b""] * n
        for k in range(n):
            if sp.is_byte(k):
                value = int(sp.id_to_piece(k)[3:5], 16)
                self.byte_id[value] = k
                spelt[k] = bytes([value])
        for k in plain:
            spelt[k] = sp.id_to_piece(k).replace(SPACE, " ").encode()
        self.piece_len = np.array([len(s) for s in spelt])
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(spelt), np.uint8)
        order = sorted(plain, key=lambda k: (-sp.get_score(k), k))
        self.weight = np.full(n, -np.log(len(order) + 2.0))
        self.weight[order] = -np.log(np.arange(len(order)) + 2.0)
        self.weight -= np.log(np.exp(self.weight[order]).sum())
        starts = [self._starts(np.array([ord(c) for c in sp.id_to_piece(k)], np.uint64)) for k in plain]
        h = np.array([x[-1] for x in starts], np.uint64)
        slot = (h * _B) >> np.uint64(44)
        by = np.argsort(slot)[::-1]
        self.hash, self.id = h[by], np.array(plain, np.int32)[by]
        self.where, self.more = np.full(1 << 20, -1, np.int32), np.zeros(1 << 20, bool)
        self.where[slot[by]] = np.arange(len(by))  # the last piece of a slot
        self.crowd = int(np.bincount(slot.astype(np.int64)).max())
        self.more[(np.array([h for x in starts for h in x[:-1]], np.uint64) * _B) >> np.uint64(44)] = True  # starts of longer pieces
        self.keep, self.known = keep, _Seen()
        self.filled, self.buffers = dict.fromkeys(self._KINDS, 0), {c: np.empty(1 << 12, kind) for columns in self._KINDS.values() for c, kind in columns.items()}
        self.kept = (0, dict(self.filled))
        self._expose()

    @staticmethod
    def _starts(chars: np.ndarray) -> list[int]:
        """Hashes of the first one, two, ... characters."""
        out, h = [], 0
        for c in mix(chars + np.uint64(1)).tolist():
            h = (h * int(_B) + c) & 0xFFFFFFFFFFFFFFFF
            out.append(h)
        return out

    # the table of units

    def _append(self, kind: str, **columns: np.ndarray) -> None:
        at = self.filled[kind]
        for name, values in columns.items():
            end, buffer = at + len(values), self.buffers[name]
            if end > len(buffer):
                self.buffers[name] = np.empty(end + end // 4, buffer.dtype)
                self.buffers[name][:at] = buffer[:at]
            self.buffers[name][at:end] = values
        self.filled[kind] = end

    def _expose(self) -> None:
        for kind, columns in self._KINDS.items():
            for name in columns:
                setattr(self, name, self.buffers[name][: self.filled[kind]])

    def units(self, texts: list[str], lattice: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The unit at each place and how many places each text has; units not met before join the table."""
        if self.filled["id"] > self.keep:  # forget what came after the table was full
            n, filled = self.kept
            while len(self.known) > n:
                self.known.popitem()
            self.filled = dict(filled)
        known, places, counts = self.known, [], []
        known.fresh = fresh = []
        for text in texts:
            # without the space that begins each; spaces in a row, or at an end, begin a unit together
            if "  " in text or text[:1] == " " or text[-1:] == " ":
                found = [u[1:] for u in _UNIT.findall(" " + text)]
            else:
                found = text.split(" ") if text else []
            counts.append(len(found))
            places += map(known.__getitem__, found)
        if fresh:
            fresh = [" " + u for u in fresh]
            zeros = np.zeros(len(fresh), np.int64)
            lattices = self._lattice(fresh) if lattice else {"unit_at": zeros, "unit_len": zeros}
            self._append("unit", **lattices, **self._encode(fresh))
            self._expose()
        if self.filled["id"] <= self.keep:
            self.kept = (len(known), dict(self.filled))
        return np.array(places, np.int64), np.array(counts, np.int64)

    def _encode(self, units: list[str]) -> dict[str, np.ndarray]:
        """Ids of the units: many of them in one text, whose ids are told apart by their bytes; units of spaces alone one by one."""
        worded = np.fromiter((u[-1] != " " for u in units), bool, len(units))
        words = list(itertools.compress(units, worded))
        flat = [np.zeros(0, np.int32)]
        for at in range(0, len(words), 4096):
            flat.append(np.array(self.sp.encode("".join(words[at : at + 4096])[1:]), np.int32))
        flat = np.concatenate(flat)
        size = np.zeros(len(units), np.int64)
        raw = np.fromiter((len(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
        ends = np.searchsorted(np.cumsum(self.piece_len[flat]), np.cumsum(raw), "right")
        size[worded] = np.diff(ends, prepend=0)
        blank = {k: self.sp.encode(units[k][1:]) or [self.sp.piece_to_id(SPACE)] for k in np.flatnonzero(~worded).tolist()}
        size[list(blank)] = [len(x) for x in blank.values()]
        start = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), np.int32)
        ids[_ranges(start[worded], size[worded])] = flat
        for k, x in blank.items():
            ids[start[k] : start[k] + size[k]] = x
        at = self.filled["id"] + start
        self._append("id", unit_ids=ids)
        return {"id_at": at, "id_n": size}

    # encoding and decoding

    def encode(self, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        n = self.id_n[places]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        return self.unit_ids[_ranges(self.id_at[places], n)], np.diff(ends)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids."""
        size = self.piece_len[ids]
        data = self.piece_bytes[_ranges(self.piece_at[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return [data[a:b].decode("utf-8", "replace")[1:] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    # the lattice of the distinct units

    def _pieces(self, chars: np.ndarray, left: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, pieces) that the characters spell, without crossing from one unit into the next."""
        n = len(chars)
        mixed, rolling, here, found, k = mix(chars + np.uint64(1)), np.zeros(n, np.uint64), np.arange(n, dtype=np.int32), [], 0
        while len(here):
            rolling = rolling * _B + mixed[here + k]
            slot = (rolling * _B) >> np.uint64(44)
            at = self.where[slot]
            likely = np.flatnonzero(at >= 0)
            asked, at = rolling[likely], at[likely]
            hit = self.hash[at] == asked
            for _ in range(self.crowd - 1):
                miss = np.flatnonzero(~hit)
                at[miss] -= 1
                hit[miss] = self.hash[at[miss]] == asked[miss]
            places, ids = here[likely[hit]], self.id[at[hit]]
            if k == 0:
                spelt = np.ones(n, bool)
                spelt[places] = False
                spelt = np.flatnonzero(spelt).astype(np.int32)
                found.append((1, spelt, np.full(len(spelt), -1, np.int32)))
            found.append((k + 1, places, ids))
            k += 1
            go = self.more[slot] & (left[here] > k)
            here, rolling = here[go], rolling[go]
        return found

    def _lattice(self, units: list[str]) -> dict[str, np.ndarray]:
        """The choices at each place of a unit, the longest first: cumulative probability, logarithms of its own and of
        all the others' together, length, piece.

        A place's choices stand from ``first`` on; piece -1 stands for a character spelt in bytes.
        """
        length = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
        base, edge_base = self.filled["place"], self.filled["edge"]
        n = len(chars)
        left = (np.repeat(np.cumsum(length), length) - np.arange(n)).astype(np.int32)
        found = self._pieces(chars.astype(np.uint64), left)
        bytes_here = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
        degree_of = np.zeros(n, np.int32)
        for _, places, _ in found:
            degree_of[places] += 1

        # backward log-sums, place by place from the units' ends; places stand in that order
        longest = int(left.max(initial=0))
        owner = np.argsort(left.astype(np.uint16) if longest < 1 << 16 else left, kind="stable").astype(np.int32)
        degree = degree_of[owner]
        first = (np.cumsum(degree) - degree).astype(np.int32)
        n_edges = int(degree.sum())
        fill = np.empty(n, np.int32)
        fill[owner] = first
        size, piece, to = np.empty(n_edges, np.int8), np.empty(n_edges, np.int32), np.empty(n_edges, np.int32)
        score = np.empty(n_edges)
        for k, places, ids in reversed(found):
            at = fill[places]
            size[at], piece[at], to[at] = k, ids, np.where(left[places] == k, n, places + k)
            score[at] = self.weight[ids] if len(ids) and ids[0] >= 0 else self.weight[self.byte_id[0]] * bytes_here[places]
            fill[places] += 1
        del found
        steps = np.searchsorted(left[owner], np.arange(1, longest + 2))
        sums = np.zeros(n + 1)
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            if a == b:
                continue
            lo, hi = first[a], first[b] if b < n else n_edges
            part = score[lo:hi] + sums[to[lo:hi]]
            cut, deg = first[a:b] - lo, degree[a:b]
            top = np.maximum.reduceat(part, cut)
            total = top + np.log(np.add.reduceat(np.exp(part - np.repeat(top, deg)), cut))
            sums[owner[a:b]] = total
            score[lo:hi] = part - np.repeat(total, deg)
        del to, sums

        # what the others have together is summed, never taken from one
        chance = np.exp(score)
        total = np.cumsum(chance)
        cum = total - np.repeat(total[first] - chance[first], degree)
        cum[first + degree - 1] = 1.0
        best = np.flatnonzero(chance > 0.5)
        chance[best] = 0.0
        with np.errstate(divide="ignore"):
            log_rest = np.log1p(-chance)
            log_rest[best] = np.log(np.repeat(np.add.reduceat(chance, first), degree)[best]) if n_edges else 0.0
        self._append("edge", cum=cum, log_prob=score, log_rest=log_rest, size=size, piece=piece)
        first_of, degree_of = np.empty(n, np.int32), degree_of.astype(np.int8)
        first_of[owner] = first + edge_base
        self._append("place", chars=chars, bytes_here=bytes_here, first=first_of, degree=degree_of)
        return {"unit_at": base + np.cumsum(length) - length, "unit_len": length}

    # sampling

    def _walk(self, places, row, place, seed, sample: int, leave=None):
        """Complete one path per unit place: (number of choices of each, and of all choices the place in the lattice and which).

        ``leave`` is, by unit place, the step at which it leaves a given path, the choice it takes there, and that
        path: (step, choice, offset, choices).
        """
        left = self.unit_len[places].copy()
        active, step, at = np.arange(len(places)), 0, self.unit_at[places]
        key = mix(seed[row] + mix(np.array([sample], np.uint64))) + place.astype(np.uint64) * _B
        got = []
        while len(active):
            a = at[active]
            u = ((mix(key[active] + np.uint64(step << 40)) >> np.uint64(41)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23)
            choice = self.first[a]
            todo = np.flatnonzero(u >= self.cum[choice])
            while len(todo):
                choice[todo] += 1
                todo = todo[u[todo] >= self.cum[choice[todo]]]
            if leave is not None:
                when, other, offset, choices = leave
                given = when[active]
                choice = np.where(step < given, choices[np.minimum(offset[active] + step, len(choices) - 1)], np.where(step == given, other[active], choice))
            size = self.size[choice].astype(np.int64)
            got.append((active, a, choice))
            at[active] = a + size
            left[active] -= size
            active, step = active[left[active] > 0], step + 1
        n = np.zeros(len(places), np.int64)
        for active, _, _ in got:
            n[active] += 1
        offset = np.cumsum(n) - n
        path_at, path_choice = np.zeros(n.sum(), np.int64), np.zeros(n.sum(), np.int64)
        for step, (active, a, choice) in enumerate(got):
            to = offset[active] + step
            path_at[to], path_choice[to] = a, choice
        return n, path_at, path_choice

    def _rewalk(self, places, row, place, seed, sample: int, old, leave):
        """A path that follows ``old`` (by unit place its number of choices and their offset, then all places and choices) up to where ``leave`` (place, step, choice by
        row) branches off, and is drawn from there on."""
        (n, offset, at, choices), (b_place, b_step, b_choice) = old, leave
        walk = np.flatnonzero(place >= b_place[row])
        r = row[walk]
        when = np.where(place[walk] == b_place[r], b_step[r], -1)
        n_new, at_new, choice_new = self._walk(places[walk], r, place[walk], seed, sample, (when, b_choice[r], offset[walk], choices))
        n, offset = n.copy(), offset.copy()
        n[walk], offset[walk] = n_new, len(at) + np.cumsum(n_new) - n_new
        take = _ranges(offset, n)
        return n, np.concatenate([at, at_new])[take], np.concatenate([choices, choice_new])[take]

    def sample(self, places: np.ndarray, counts: np.ndarray, seeds: np.ndarray, k: int) -> list[dict]:
        """k rounds; each has, by text: ids (in a row), n, log_prob, perturbed, log_inclusion, found."""
        n = len(counts)
        row, place = np.repeat(np.arange(n), counts), _ranges(np.zeros(n, np.int64), counts)
        value = -np.log(-np.log(_uniform(seeds, np.full(n, 77, np.uint64))))
        paths = [self._path(self._walk(places, row, place, seeds, 0), row, seeds, 0, value, np.ones(n, bool))]
        for s in range(1, k + 1):
            best = np.stack([p["best"] for p in paths])
            value = best.max(0)
            if s < k:
                paths.append(self._branch(paths, best.argmax(0), value, places, row, place, seeds, s))
        return self._finish(paths, value)

    def _path(self, walked, row, seeds, s: int, value, alive, cut=None, log_left=None) -> dict:
        """Give every choice of a path the priority of the paths that leave it there.

        Choices before ``cut`` belong to an earlier path; at ``cut`` the choices not yet taken weigh ``log_left``.
        """
        n, at, taken_here = walked
        token_row = np.repeat(row, n)
        first = np.concatenate([[0], np.cumsum(np.bincount(token_row, minlength=len(value)))])
        running = np.concatenate([[0.0], np.cumsum(self.log_prob[taken_here])])
        base = running[first[:-1]]
        log_rest = self.log_rest[taken_here].astype(np.float64)
        token = np.arange(len(at)) - first[:-1][token_row]
        if cut is not None:
            own = np.flatnonzero(alive)
            log_rest[first[own] + cut[own]] = log_left[own]
        draw = -np.log(_uniform(seeds[token_row] + np.uint64((1000 + s) << 32), token.astype(np.uint64)))
        phi = running[:-1] - base[token_row] + log_rest
        open_ = np.isfinite(phi) if cut is None else np.isfinite(phi) & (token >= cut[token_row])
        priority = np.full(len(at), -np.inf)
        priority[open_] = -np.logaddexp(-value[token_row[open_]], np.log(draw[open_]) - phi[open_])
        offset = np.cumsum(n) - n
        out = {"n": n, "offset": offset, "at": at, "choice_at": taken_here, "first": first, "row": token_row, "priority": priority, "value": value, "alive": alive, "log_prob": running[first[1:]] - base, "taken": {}}
        self._best(out)
        return out

    @staticmethod
    def _best(path: dict) -> None:
        """By text: the largest priority of the path's choices, and which choice has it."""
        n = len(path["first"]) - 1
        best, choice = np.full(n, -np.inf), np.zeros(n, np.int64)
        some = np.flatnonzero(np.diff(path["first"]) > 0)
        if len(some):
            best[some] = np.maximum.reduceat(path["priority"], path["first"][some])
            is_best = np.flatnonzero(path["priority"] == best[path["row"]])
            choice[path["row"][is_best[::-1]]] = is_best[::-1]
        path["best"], path["choice"] = np.where(path["alive"], best, -np.inf), choice

    def _branch(self, paths, which, value, places, row, place, seeds, s: int) -> dict:
        """Pop the best node of each text: leave its path at its choice for one not yet taken there, and walk on."""
        n = len(value)
        alive = np.isfinite(value)
        cut, lattice_at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        b_place, b_step = np.full(n, 1 << 60), np.zeros(n, np.int64)
        most = int(self.degree.max(initial=1))
        taken = np.zeros((most, n), bool)
        old_n, old_at = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        shift = 0
        for k, p in enumerate(paths):  # the parent's path of each text, put together from the paths so far
            mine = np.flatnonzero(alive & (which == k))
            choice = p["choice"][mine]
            cut[mine], lattice_at[mine] = choice - p["first"][mine], p["at"][choice]
            taken[p["choice_at"][choice] - self.first[p["at"][choice]], mine] = True
            at_unit = np.searchsorted(p["offset"], choice, "right") - 1
            b_place[mine], b_step[mine] = place[at_unit], choice - p["offset"][at_unit]
            for r in mine.tolist() if p["taken"] else ():
                if r in p["taken"] and p["taken"][r][0] == cut[r]:
                    taken[:, r] |= p["taken"][r][1]
            sel = (alive & (which == k))[row]
            old_n[sel], old_at[sel] = p["n"][sel], p["offset"][sel] + shift
            shift += len(p["at"])
            p["priority"][choice] = -np.inf  # this node is spent; the new path carries what is left of it
            self._best(p)
        chance = np.full((most, n), -np.inf)
        for d in range(most if len(self.first) else 0):
            has = np.flatnonzero(alive & (self.degree[lattice_at] > d))
            chance[d, has] = self.log_prob[self.first[lattice_at[has]] + d]
        chance[taken] = -np.inf
        scale = chance.max(0, initial=-np.inf)
        alive &= np.isfinite(scale)
        scale = np.where(alive, scale, 0.0)
        free = np.cumsum(np.exp(chance - scale), 0)
        pick = np.minimum((_uniform(seeds, np.full(n, 5000 + s, np.uint64)) * free[-1] >= free).sum(0), most - 1)
        chance[pick, np.arange(n)] = -np.inf
        with np.errstate(divide="ignore"):
            log_left = scale + np.log(np.exp(chance - scale).sum(0))
        taken[pick, np.arange(n)] = True
        base = self.first[lattice_at] if len(self.first) else lattice_at
        old = (old_n, old_at, np.concatenate([p["at"] for p in paths]), np.concatenate([p["choice_at"] for p in paths]))
        walked = self._rewalk(places, row, place, seeds, s, old, (np.where(alive, b_place, 1 << 60), b_step, base + pick))
        new = self._path(walked, row, seeds, s, np.where(alive, value, -np.inf), alive, cut, log_left)
        new["taken"] = {int(r): (cut[r], taken[:, r]) for r in np.flatnonzero(alive)}
        return new

    def _ids(self, path: dict) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a path, and how many each text has; texts whose search was over have none."""
        keep = path["alive"][path["row"]]
        at, row = path["at"][keep], path["row"][keep]
        piece = self.piece[path["choice_at"][keep]]
        n = np.where(piece < 0, self.bytes_here[at], 1)
        ids = np.repeat(piece, n)
        spelt = at[piece < 0]
        if len(spelt):
            raw = "".join(map(chr, self.chars[spelt].astype(np.int64).tolist())).encode("utf-8", "surrogatepass")
            ids[ids < 0] = self.byte_id[np.frombuffer(raw, np.uint8)]
        return ids, np.bincount(np.repeat(row, n), minlength=len(path["alive"]))

    def _finish(self, paths: list[dict], threshold: np.ndarray) -> list[dict]:
        out = []
        for p in paths:
            ids, n = self._ids(p)
            above = np.where(np.isfinite(threshold), np.minimum(p["log_prob"] - threshold, 50), 50)
            log_inclusion = np.where(above < -30, above, np.log(-np.expm1(-np.exp(np.maximum(above, -30)))))
            out.append({"ids": ids, "n": n, "log_prob": p["log_prob"], "perturbed": p["value"], "log_inclusion": log_inclusion, "found": p["alive"]})
        return out


IDS = pa.list_(pa.int32())


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


@lru_cache(1)
def _codec(model: bytes) -> Codec:
    """One for all tasks of a worker, with the units it has met."""
    return Codec(model)


def _run(model, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codec = _codec(model.value)
            for at in range(0, batch.num_rows, _ROWS):
                yield from some(codec, batch.slice(at, _ROWS))

    def some(codec: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seeds = np.asarray(batch.column("_seed").to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
        at = 0
        for part in chunks(batch.column("_text").to_pylist(), _CHUNK):
            places, counts = codec.units(part, lattice=k > 0)
            ids, n = codec.encode(places, counts)
            back = codec.decode(ids, n)
            columns = {"_id": batch.column("_id").slice(at, len(part)), "ids": _lists(ids, n), "round_trip": pa.array([a == b for a, b in zip(part, back, strict=True)])}
            del back
            if k:
                for j, s in enumerate(codec.sample(places, counts, seeds[at : at + len(part)], k)):
                    values = [_lists(s["ids"], s["n"]), *(pa.array(np.where(s["found"], np.round(s[c], 6), 0.0)) for c in ("log_prob", "perturbed", "log_inclusion")), pa.array(s["found"])]
                    columns[f"_s{j}"] = pa.StructArray.from_arrays(values, ["ids", "log_prob", "perturbed", "log_inclusion", "found"])
            at += len(part)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 0, model: str = MODEL) -> DataFrame:
    """One row per document: id, ids, round_trip (decoding gives the text again), and with k > 0 samples, an array
    of (ids, log_prob, perturbed, log_inclusion) in order of the perturbed log-probability."""
    with open(model, "rb") as file:  # some hundred kB
        data = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), F.xxhash64(F.col(id_col), F.lit(7)).alias("_seed"))
    kind = docs.schema[id_col].dataType.simpleString()
    one = "struct<ids:array<int>,log_prob:double,perturbed:double,log_inclusion:double,found:boolean>"
    out = rows.mapInArrow(_run(data, k), f"_id {kind}, ids array<int>, round_trip boolean" + "".join(f", _s{j} {one}" for j in range(k)))
    if k:
        found = F.filter(F.array(*[F.col(f"_s{j}") for j in range(k)]), lambda x: x["found"])
        out = out.withColumn("samples", F.transform(found, lambda x: F.struct(*[x[c].alias(c) for c in ("ids", "log_prob", "perturbed", "log_inclusion")])))
    return out.select(F.col("_id").alias(id_col), "ids", "round_trip", *["samples"][: min(k, 1)])
