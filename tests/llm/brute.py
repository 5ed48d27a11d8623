"""Brute-force versions that several test modules hold the operators against."""

import re
from itertools import combinations

import xxhash


def brute_fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(sign) + 32) if "A" <= sign <= "Z" else sign for sign in text or ""))
    shingles = [" ".join(words[place : place + size]) for place in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(one.encode(), 42) for one in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(value >> bit & 1 for value in hashes) > len(hashes))


def brute_components(prints, distance):
    root = list(range(len(prints)))

    def find(one):
        while root[one] != one:
            one = root[one]
        return one

    for one, other in combinations(range(len(prints)), 2):
        if (prints[one] ^ prints[other]).bit_count() <= distance:
            low, high = sorted((find(one), find(other)))
            root[high] = low
    return [find(one) for one in range(len(prints))]


def water_level(sizes, weights, share, most):
    """Targets by handing the excess on until none is above its cap."""
    target, open_ones, left = {}, set(sizes), share * sum(sizes.values())
    while open_ones:
        total = sum(weights[one] for one in open_ones)
        over = [one for one in open_ones if left * weights[one] / total > most * sizes[one]]
        if not over:
            return target | {one: left * weights[one] / total for one in open_ones}
        for one in over:
            target[one] = most * sizes[one]
            left -= target[one]
            open_ones.discard(one)
    return target
