"""What plans do to files, on the driver, one step at a time: never over an existing file, and undone when a step fails."""

from __future__ import annotations

import json
import os
import re
import shutil
from collections.abc import Callable, Iterable

from ..sources.archives import ArchiveError, extract_member, members, page_index, write_zip

TEMP = ".shelfwright-tmp-"


class Clobber(FileExistsError):
    """The target exists and is another file."""


def inside(root: str, rel: str) -> str:
    """The path below root; one that leads out of it is refused."""
    top = os.path.realpath(root)
    path = os.path.realpath(os.path.join(top, rel))
    if os.path.commonpath([top, path]) != top:
        raise PermissionError(rel)
    return path


def move(source: str, target: str) -> None:
    """Renames, also where only the case differs; copies with a check of the size between file systems."""
    if os.path.exists(target) and not os.path.samefile(source, target):
        raise Clobber(target)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    try:
        os.rename(source, target)
    except OSError:
        shutil.copy2(source, target)
        if os.path.getsize(source) != os.path.getsize(target):
            os.remove(target)
            raise
        os.remove(source)


def apply_moves(steps: Iterable[tuple[str, str]], source_root: str, target_root: str, log: str) -> list[tuple[str, str]]:
    """Moves (from, to) one by one; each is logged before it happens. A target that exists stops it, what is done stays done."""
    done = []
    with open(log, "a", encoding="utf-8") as f:
        for a, b in steps:
            source, target = inside(source_root, a), inside(target_root, b)
            f.write(json.dumps({"from": a, "to": b}, ensure_ascii=False) + "\n")
            f.flush()
            move(source, target)
            done.append((a, b))
    return done


def apply_renames(root: str, steps: Iterable[tuple[str, str]], journal: str, commit: Callable[[], None] = lambda: None) -> int:
    """All steps and then ``commit``, or none: on an error the moves are undone in reverse."""
    steps = [(inside(root, a), inside(root, b)) for a, b in steps]
    with open(journal, "a", encoding="utf-8") as f:
        f.writelines(json.dumps({"from": a, "to": b}, ensure_ascii=False) + "\n" for a, b in steps)
    done: list[tuple[str, str]] = []
    try:
        for a, b in steps:
            if a != b:
                move(a, b)
                done.append((a, b))
        commit()
    except BaseException:
        for a, b in reversed(done):
            os.rename(b, a)
        raise
    return len(done)


def retire(root: str, attic: str, rel: str) -> str:
    """Moves a file to the attic, beside others of its name."""
    stem, ext = os.path.splitext(os.path.join(attic, rel))
    target, n = stem + ext, 2
    while os.path.exists(target):
        target, n = f"{stem} ({n}){ext}", n + 1
    move(inside(root, rel), target)
    return target


def run_split(source: str, parts: list[tuple[str, list[str]]], attic: str, kind: str = "folders") -> list[str]:
    """Writes (name, members) beside the source under temporary names, checks their pages, publishes them, retires the source; on an error nothing is left.

    Of a ``nested`` plan each part is one archive within the source, which becomes a file as it is.
    """
    folder = os.path.dirname(source)
    temps, out = [], []
    try:
        for name, chosen in parts:
            if os.path.exists(os.path.join(folder, name)):
                raise Clobber(name)
            temps.append(os.path.join(folder, TEMP + name))
            if kind == "nested":
                (member,) = chosen
                whole = extract_member(source, member, temps[-1]) == os.path.getsize(temps[-1])
            else:
                write_zip(temps[-1], source, chosen)
                whole = sorted(m["name"] for m in members(temps[-1])) == sorted(chosen)
            if not whole or not page_index(members(temps[-1]))["pages"]:
                raise ArchiveError(f"{name} lacks pages")
        for temp, (name, _) in zip(temps, parts):
            out.append(os.path.join(folder, name))
            os.rename(temp, out[-1])
        retire(folder, attic, os.path.basename(source))
    except BaseException:
        for path in [*temps, *out]:
            if os.path.exists(path):
                os.remove(path)
        raise
    return out


def undouble(path: str) -> str:
    """Takes `` (2)`` and the like off a file's name where the plain name is free; returns the name it has then."""
    stem, ext = os.path.splitext(path)
    bare = re.sub(r" \([0-9]{1,3}\)$", "", stem) + ext
    if bare != path and not os.path.exists(bare):
        os.rename(path, bare)
        return bare
    return path


def sweep(folder: str) -> int:
    """Removes what an ended run left behind."""
    left = [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.startswith(TEMP)]
    for path in left:
        os.remove(path)
    return len(left)
