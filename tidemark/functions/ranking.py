"""Top-k over score vectors with fixed tie rules."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let
from .text import _col


def ranked_pairs(scores, k: int) -> Column:
    """The ``k`` best as structs ``(neg, id)``, best first; equal scores go to the lower class."""
    pairs = F.transform(_col(scores).cast("array<double>"),
                        lambda p, i: F.struct((-p).alias("neg"), i.alias("id")))
    return F.slice(F.array_sort(pairs), 1, k)


def top_k(scores, k: int = 5) -> Column:
    """Class ids of the ``k`` highest scores."""
    return F.transform(ranked_pairs(scores, k), lambda s: s["id"])


def joint_top_k(p_verb, p_noun, k: int = 5, search: int = 10, num_nouns: int = 300) -> Column:
    """Ids ``verb * num_nouns + noun`` of the ``k`` largest products.

    A pair among the best ``k`` has its verb among the best ``k`` verbs and its noun among the best
    ``k`` nouns, so looking at ``search >= k`` of each is exact."""
    if search < k:
        raise ValueError("search must be at least k")
    def pairs(nouns):
        return F.flatten(F.transform(ranked_pairs(p_verb, search), lambda v: F.transform(nouns, lambda n: F.struct(
            (-(v["neg"] * n["neg"])).alias("neg"),
            (v["id"].cast("long") * num_nouns + n["id"]).alias("id")))))

    best = let(ranked_pairs(p_noun, search), lambda nouns: F.slice(F.array_sort(pairs(nouns)), 1, k))
    return F.transform(best, lambda s: s["id"])


def joint_hit(p_verb, p_noun, verb, noun, k: int = 5, num_nouns: int = 300) -> Column:
    """Whether (verb, noun) is in ``joint_top_k``, by counting better pairs instead of sorting."""
    return joint_hit_ranked(ranked_pairs(p_verb, k), ranked_pairs(p_noun, k), verb, noun, k)


def joint_hit_ranked(verbs: Column, nouns: Column, verb, noun, k: int = 5) -> Column:
    """``joint_hit`` on ranked pairs: the label must be in both lists, with fewer than ``k`` pairs
    ahead of it (larger product, or equal product and lower id)."""
    verb, noun = _col(verb), _col(noun)
    mine_v = F.get(F.filter(verbs, lambda s: s["id"] == verb), F.lit(0))["neg"]
    mine_n = F.get(F.filter(nouns, lambda s: s["id"] == noun), F.lit(0))["neg"]

    def count(mine):
        def row(v):
            def ahead(n):
                score = v["neg"] * n["neg"]
                lower = (v["id"] < verb) | ((v["id"] == verb) & (n["id"] < noun))
                return (score > mine) | ((score == mine) & lower)
            return F.size(F.filter(nouns, ahead))
        return F.when(mine.isNull(), F.lit(False)).otherwise(F.aggregate(verbs, F.lit(0), lambda acc, v: acc + row(v)) < k)

    return let(mine_v * mine_n, count)
