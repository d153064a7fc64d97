"""Lazy greedy picks from a pool of many projects.

A project's score can only fall as more skills are covered, so a score of an earlier round bounds it from above.  The first scores come from an inverted index
of the tags, over the skills of a posting alone; after that a heap by bound is asked, and only what comes up with an old score is scored again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


class Pool:
    """Projects (id, prefer, pos, norm, tags) with the index of their tags: for each skill the projects that have it, and how deep."""

    def __init__(self, projects: Sequence[tuple[str, int, int, float, dict[str, float]]]):
        self.projects = sorted(projects, key=lambda p: (-p[1], p[2]))  # by preference and place
        index: dict[str, list[tuple[int, float]]] = {}
        for i, (*_, tags) in enumerate(self.projects):
            for skill, depth in tags.items():
                index.setdefault(skill, []).append((i, depth))
        self.index = {skill: (np.array([i for i, _ in found]), np.array([d for _, d in found])) for skill, found in index.items()}
        self.norms = np.array([p[3] for p in self.projects])

    def _score(self, i: int, weights: list[tuple[str, float]], covered: dict[str, float], discount: float) -> float:
        tags, total = self.projects[i][4], 0.0
        for skill, weight in weights:
            if skill in tags:
                total += weight * tags[skill] * (1 - discount * covered.get(skill, 0.0))
        return total / self.projects[i][3]

    def pick(self, weights: list[tuple[str, float]], k: int, discount: float) -> tuple[list[str], list[float], dict[str, float]]:
        """ids, scores and covered depths of ``k`` greedy picks; of equal scores the preferred, then the earlier project.  ``weights`` are by skill and not negative."""
        first = np.zeros(len(self.projects))
        for skill, weight in weights:
            if skill in self.index:
                at, depth = self.index[skill]
                first[at] += weight * depth
        touched = np.flatnonzero(first)
        heap = [(-score, i, 0) for score, i in zip((first[touched] / self.norms[touched]).tolist(), touched.tolist(), strict=True)]
        heapq.heapify(heap)
        rest = 0  # projects that share no skill score 0, in their order
        picks: list[int] = []
        scores: list[float] = []
        covered: dict[str, float] = {}
        chosen: set[int] = set()
        for turn in range(min(k, len(self.projects))):
            while rest < len(first) and (rest in chosen or first[rest]):
                rest += 1
            while heap and heap[0][2] < turn:
                _, i, _ = heap[0]
                heapq.heapreplace(heap, (-self._score(i, weights, covered, discount), i, turn))
            if heap and (rest == len(first) or (heap[0][0], heap[0][1]) < (0.0, rest)):
                score, i, _ = heapq.heappop(heap)
                score = -score
            else:
                score, i = 0.0, rest
            chosen.add(i)
            picks.append(i)
            scores.append(score)
            for skill, depth in self.projects[i][4].items():
                covered[skill] = max(covered.get(skill, 0.0), depth)
        return [self.projects[i][0] for i in picks], scores, covered


def lazy_picks(shared, k: int, discount: float):
    """For ``mapInArrow``: rows (doc, w) to doc, picks, scores, coverage and uncovered, by a broadcast pool."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = shared.value
        for batch in batches:
            picks, scores, shares, gaps = [], [], [], []
            for w in batch.column(1).to_pylist():
                weights = [(e["skill"], e["weight"]) for e in w]
                ids, found, covered = pool.pick(weights, k, discount)
                total = met = 0.0
                for skill, weight in weights:
                    total += weight
                    met += weight * min(1.0, covered.get(skill, 0.0))
                picks.append(ids)
                scores.append(found)
                shares.append(met / total if total > 0 else 0.0)
                gaps.append([skill for _, skill in sorted((-weight, skill) for skill, weight in weights if skill not in covered)[:8]])
            lists = pa.array(picks, pa.list_(pa.string())), pa.array(scores, pa.list_(pa.float64())), pa.array(shares, pa.float64()), pa.array(gaps, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc", "picks", "scores", "coverage", "uncovered"])

    return run
