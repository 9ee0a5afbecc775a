"""What the stages of a load took: seconds, bytes written to scratch, and counts."""

from __future__ import annotations

import contextlib
import dataclasses
import json
import time
from collections.abc import Callable, Iterator


@dataclasses.dataclass
class Stages:
    """A list of stages in the order they ended, each with its name, seconds and what it noted."""

    done: list[dict] = dataclasses.field(default_factory=list)

    @contextlib.contextmanager
    def stage(self, name: str) -> Iterator[Callable[..., None]]:
        """Times its body, which may note counts by calling what it gets; a stage that fails is noted with its error."""
        row: dict = {"stage": name}
        start = time.perf_counter()
        try:
            yield row.update
        except BaseException as e:
            row["error"] = f"{type(e).__name__}: {e}"
            raise
        finally:
            row["seconds"] = round(time.perf_counter() - start, 3)
            self.done.append(row)

    def total(self) -> float:
        return round(sum(r["seconds"] for r in self.done), 3)

    def to_json(self) -> str:
        return json.dumps({"stages": self.done, "seconds": self.total()})
