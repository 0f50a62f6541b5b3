"""Page selections such as `1,3-5`."""

from __future__ import annotations


class PageSelectionError(ValueError):
    pass


def parse(spec: str) -> list[tuple[int, int]]:
    """Ranges of a selection; each part is a page or first-last, all positive."""
    out = []
    for part in spec.split(","):
        ends = part.strip().split("-")
        if len(ends) > 2 or not all(e.strip().isascii() and e.strip().isdigit() for e in ends):
            raise PageSelectionError(f"Invalid page selection: {part.strip()!r}")
        first, last = int(ends[0]), int(ends[-1])
        if first < 1 or last < first:
            raise PageSelectionError(f"Invalid page range: {part.strip()!r}")
        out.append((first, last))
    return out


def resolve(spec: str | None, page_count: int) -> list[int]:
    """Distinct ascending pages of a document; no selection means all."""
    if spec is None:
        return list(range(1, page_count + 1))
    pages = sorted({p for a, b in parse(spec) for p in range(a, min(b, page_count + 1) + 1)})
    if pages and pages[-1] > page_count:
        raise PageSelectionError(f"Requested page {pages[-1]} exceeds document page count of {page_count}")
    return pages


def mib_to_bytes(mib: int) -> int:
    if mib <= 0 or mib > (2**63 - 1) >> 20:
        raise ValueError("Size limit must be a positive number of MiB")
    return mib << 20
