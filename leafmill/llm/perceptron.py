"""An averaged perceptron over sparse features, small enough to go to every task."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Hashable, Sequence


class Perceptron:
    """Multi-class averaged perceptron; features and labels are any hashable values."""

    def __init__(self) -> None:
        self.weights: dict[Hashable, dict[Hashable, float]] = {}
        self.labels: list[Hashable] = []

    def scores(self, features: Sequence[Hashable], labels: Sequence[Hashable] | None = None) -> dict[Hashable, float]:
        found: dict[Hashable, float] = dict.fromkeys(labels if labels is not None else self.labels, 0.0)
        weights = self.weights
        for feature in features:
            if feature in weights:
                for label, weight in weights[feature].items():
                    if label in found:
                        found[label] += weight
        return found

    def predict(self, features: Sequence[Hashable], labels: Sequence[Hashable] | None = None) -> Hashable:
        """The best label; None where nothing has been learnt."""
        found = self.scores(features, labels)
        return max(found, key=lambda label: (found[label], str(label)), default=None)

    def fit(self, examples: list[tuple[Sequence[Hashable], Hashable, Sequence[Hashable] | None]], epochs: int = 4, seed: int = 5) -> Perceptron:
        """Examples are (features, label, permitted labels or None for all)."""
        self.labels = sorted({label for _, label, _ in examples}, key=str)
        totals: dict[tuple, float] = defaultdict(float)
        since: dict[tuple, int] = defaultdict(int)
        weights: dict[Hashable, dict[Hashable, float]] = defaultdict(dict)
        self.weights = weights
        step, rng = 0, random.Random(seed)

        def change(feature: Hashable, label: Hashable, by: float) -> None:
            key, now = (feature, label), weights[feature].get(label, 0.0)
            totals[key] += (step - since[key]) * now
            since[key] = step
            weights[feature][label] = now + by

        order = list(range(len(examples)))
        for _ in range(epochs):
            rng.shuffle(order)
            for i in order:
                features, label, permitted = examples[i]
                step += 1
                guess = self.predict(features, permitted)
                if guess != label:
                    for feature in features:
                        change(feature, label, 1.0)
                        change(feature, guess, -1.0)
        averaged: dict[Hashable, dict[Hashable, float]] = {}
        for feature, by_label in weights.items():
            own = {label: (totals[feature, label] + (step - since[feature, label]) * now) / max(1, step) for label, now in by_label.items()}
            averaged[feature] = {label: round(weight, 4) for label, weight in own.items() if abs(weight) > 1e-4}
        self.weights = averaged
        return self
