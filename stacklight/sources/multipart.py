"""Random access to an archive in one file or in parts named with the suffixes aa to zz."""

from __future__ import annotations

import bisect
import os
import string

SUFFIXES = [a + b for a in string.ascii_lowercase for b in string.ascii_lowercase]


def part_files(path: str) -> list[str]:
    """The file itself, or its parts in order: `aa` may be missing, and the first gap after a part ends the list."""
    path = path.removeprefix("file://") if path.startswith("file:///") else path
    if os.path.isfile(path):
        return [path]
    parts: list[str] = []
    for k, s in enumerate(SUFFIXES):
        if os.path.isfile(path + s):
            parts.append(path + s)
        elif parts or k > 0:
            break
    if not parts:
        raise FileNotFoundError(path)
    return parts


class Parts:
    """Bytes at places of the parts' concatenation; each read opens no more than the parts that it touches."""

    def __init__(self, path: str):
        self.files = part_files(path)
        self.starts, total = [], 0
        for f in self.files:
            self.starts.append(total)
            total += os.path.getsize(f)
        self.size = total
        self.multipart = len(self.files) > 1
        self._open: dict[int, object] = {}

    def read_at(self, at: int, n: int) -> bytes:
        """n bytes, or as many as there are."""
        out = []
        n = max(0, min(n, self.size - at))
        while n > 0:
            k = bisect.bisect_right(self.starts, at) - 1
            end = self.starts[k + 1] if k + 1 < len(self.starts) else self.size
            if k not in self._open:
                self._open[k] = open(self.files[k], "rb")
            f = self._open[k]
            f.seek(at - self.starts[k])
            part = f.read(min(n, end - at))
            if not part:
                break
            out.append(part)
            at, n = at + len(part), n - len(part)
        return b"".join(out)

    def __enter__(self) -> Parts:
        return self

    def __exit__(self, *_: object) -> None:
        for f in self._open.values():
            f.close()
        self._open = {}


def open_parts(path: str) -> Parts:
    return Parts(path)
