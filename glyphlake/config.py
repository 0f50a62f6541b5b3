"""Options of an audit and of a batch, checked once, when they are made."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from glyphlake.functions import pages


class OptionError(ValueError):
    pass


def number(value: str, name: str, least: int) -> int:
    if not (value.isascii() and value.isdigit() and least <= int(value) < 2**31):
        raise OptionError(f"{name} must be a {'positive' if least else 'non-negative'} integer within the supported range")
    return int(value)


def mebibytes(value: str, name: str) -> int:
    try:
        return pages.mib_to_bytes(int(value))
    except ValueError:
        raise OptionError(f"{name} must be a positive integer within the supported range") from None


def points(value: str, name: str) -> float:
    try:
        x = float(value)
    except ValueError:
        x = math.nan
    if not 0 <= x < math.inf:
        raise OptionError(f"{name} must be a finite, non-negative number")
    return x


def truth(value: str, name: str) -> bool:
    if value.lower() not in ("true", "false"):
        raise OptionError(f"{name} must be true or false")
    return value.lower() == "true"


@dataclass(frozen=True)
class AuditOptions:
    folder: str
    json: bool = False
    most_bytes: int = 100 << 20
    most_pages: int = 1000
    tiny: float = 3.0
    page_selection: str | None = None

    @classmethod
    def of(cls, arguments: list[str]) -> AuditOptions:
        """Options of a command line: each once, values behind their names, one folder or file."""
        kinds = {"--max-file-size-mib": ("most_bytes", mebibytes), "--max-pages": ("most_pages", lambda v, n: number(v, n, 1)), "--tiny-text-threshold-pt": ("tiny", points), "--pages": ("page_selection", lambda v, n: pages.parse(v) and v)}
        got: dict = {}
        left = iter(arguments)
        for a in left:
            field, read = kinds.get(a, ("json" if a == "--json" else "folder", None))
            if field == "folder" and a.startswith("-"):
                raise OptionError(f"{a} must be used alone" if a in ("-h", "--help", "--version") else f"Unknown option: {a}")
            if field in got:
                raise OptionError("Only one input may be specified" if field == "folder" else f"{a} may only be specified once")
            value = next(left, None) if read else a
            if value is None:
                raise OptionError(f"{a} requires a value")
            got[field] = read(value, a) if read else a if field == "folder" else True
        if "folder" not in got:
            raise OptionError("An input is required")
        return cls(**got)


@dataclass(frozen=True)
class BatchOptions:
    workspace: Path
    report_path: Path
    fail_on_findings: bool = True
    most_annotations: int = 20
    most_files: int = 50
    most_total_bytes: int = 500 << 20
    most_bytes: int = 100 << 20
    most_pages: int = 1000
    tiny: float = 3.0

    @classmethod
    def of(cls, inputs: Mapping[str, str], workspace: str | Path) -> BatchOptions:
        """Options of named inputs, with defaults for those that aren't there."""
        get = inputs.get
        root = Path(os.path.abspath(workspace))
        return cls(
            root, output_path(root, get("report_path", "text-layer-audit.json")), truth(get("fail_on_findings", "true"), "fail_on_findings"), number(get("max_annotations", "20"), "max_annotations", 0), number(get("max_files", "50"), "max_files", 1),
            mebibytes(get("max_total_size_mib", "500"), "max_total_size_mib"), mebibytes(get("max_file_size_mib", "100"), "max_file_size_mib"), number(get("max_pages", "1000"), "max_pages", 1), points(get("tiny_text_threshold_pt", "3"), "tiny_text_threshold_pt"),
        )


@dataclass(frozen=True)
class Place:
    """Where a path of a workspace leads, or why it may not be used."""

    path: Path | None
    problem: str | None = None

    def checked(self) -> Path:
        if self.problem:
            raise OptionError(self.problem)
        return self.path


def place(workspace: str | Path, name: str | None, wanted: str) -> Place:
    """The place of a name below a workspace. wanted: `input`, a regular file that is no link and lies below the workspace when all
    links are followed; or `report`, a .json file that may be made, with no link on the way."""
    root = Path(os.path.abspath(workspace))
    if not name or not name.strip() or set("\r\n") & set(name):
        return Place(None, f"{wanted}: a path is needed")
    steps = Path(name)
    if steps.is_absolute():
        return Place(None, f"{wanted}: {name} is not relative to the workspace")
    target = Path(os.path.normpath(root / steps))
    if root != target and root not in target.parents:
        return Place(None, f"{wanted}: {name} lies outside the workspace")
    between = [p for p in (target, *target.parents) if root in p.parents]
    if wanted == "report":
        if target.suffix.lower() != ".json":
            return Place(None, f"{wanted}: {name} is no .json file")
        linked = next((p for p in between[1:] if p.is_symlink()), None)
        return Place(target, f"{wanted}: {linked} is a link" if linked else None)
    if target.is_symlink() or not target.is_file():
        return Place(None, f"{wanted}: {name} is missing, or no regular file")
    real = target.resolve()
    return Place(real) if root.resolve() in real.parents else Place(None, f"{wanted}: {name} leads outside the workspace")


def existing_file(workspace: str | Path, name: str) -> Path:
    return place(workspace, name, "input").checked()


def output_path(workspace: str | Path, name: str | None) -> Path:
    return place(workspace, name, "report").checked()


def write_report(workspace: str | Path, target: Path, content: str) -> None:
    """Puts a report in its place at once, whole, for all to read; its folder is made if need be."""
    target = output_path(workspace, os.path.relpath(target, workspace))
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_name(f".{target.name}.{os.getpid()}")
    try:
        draft.write_text(content, encoding="utf-8")
        draft.chmod(draft.stat().st_mode | 0o044)
        draft.replace(target)
    finally:
        draft.unlink(missing_ok=True)
