"""A bounded memo for values that are met again and again, such as the pieces of a text."""

from collections.abc import Callable


class Memo(dict):
    """``make(key)`` of the keys met lately, in two generations of ``kept`` keys.

    When the young generation is full it becomes the old one, and what is met again moves back:
    frequent keys stay, and no more than twice ``kept`` are held. Keys longer than ``longest`` are
    made anew each time, so the bytes held are bounded too.
    """

    def __init__(self, make: Callable, kept: int, longest: int | None = None):
        super().__init__()
        self.make, self.kept, self.longest = make, kept, longest
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if self.longest is not None and len(key) > self.longest:
                return value
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
