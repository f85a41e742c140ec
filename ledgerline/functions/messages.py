"""What messages of build tools say is missing: a reader for each tool, which takes a line apart by what that tool prints around a name.

Every reader gives an array of names; empty ones are no findings. Names are as the tool prints them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME, _HEADER, _MARK = r"[A-Za-z0-9_.+-]", r"[A-Za-z0-9_./+-]+\.h(?:pp)?", "[`'\"]"
#: Shells that say of a command only that it wasn't found.
SHELLS = ["sh", "ash", "bash", "dash", "ksh", "mksh", "zsh"]


def _low(text: Column) -> Column:
    """A text with A to Z in lower case; every other character keeps its place."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _after(text: Column, cue: str, seen: Column | None = None) -> Column:
    """What follows the first place of a cue, or null; `seen` is searched for it, if it isn't the text itself."""
    at = F.instr(text if seen is None else seen, cue)
    return F.when(at > 0, F.substr(text, at + len(cue)))


def _before(text: Column, cue: str, seen: Column | None = None) -> Column:
    at = F.instr(text if seen is None else seen, cue)
    return F.when(at > 1, F.substr(text, F.lit(1), at - 1))


def _find(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(text, pattern, 1), F.lit(""))


def _quoted(rest: Column, then: str = "") -> Column:
    """What stands in quotes at the start of a text, if `then` follows them."""
    return _find(rest, f"^{_MARK}([^`'\"]+){_MARK}{then}")


def _leading(rest: Column) -> Column:
    """The name at the start of a text, in quotes or not."""
    return _find(rest, f"^{_MARK}?({_NAME}+)")


def pkg_config(line: Column) -> Column:
    """Modules that pkg-config, or what asked it, couldn't find; of a probe's arguments the last that is no flag is the module."""
    low = _low(line)
    unknown = _find(_before(line, " was not found in the pkg-config", low), f"(?i)package '?({_NAME}+)'?$")
    library = _quoted(_after(line, "system library ", low), " required by crate")
    asked = _find(F.coalesce(_after(line, '"pkg-config"'), _after(line, '"pkg_config"')), r'^((?:\s+"[^"]*")+)')
    words = F.filter(F.split(asked, '"'), lambda a: (F.trim(a) != "") & ~F.trim(a).startswith("-"))
    failed = F.contains(line, F.lit("did not exit successfully")) | F.contains(line, F.lit("exit status"))
    module = F.when(failed & (F.size(words) > 0), F.trim(F.element_at(words, -1))).otherwise("")
    return F.array(unknown, _quoted(_after(line, "No package "), " found"), library, _quoted(_after(line, "could not find system library ")), module)


def linker(line: Column) -> Column:
    """Libraries that the linker, or the compiler for it, couldn't find."""
    sought = F.coalesce(_after(line, "cannot find "), _after(line, "unable to find "))
    flag = F.regexp_replace(sought, "^library ", "")
    return F.array(_find(flag, f"^-l({_NAME}+)"), _leading(_after(line, "could not find native static library ")))


def compiler(line: Column) -> Column:
    """Headers that a C compiler couldn't open; gcc names them before its reason, clang in quotes."""
    return F.array(_find(_before(line, ": No such file"), rf"(?:^|[\s:])({_HEADER})$"), _find(_before(line, "' file not found"), f"'({_HEADER})$"))


def shell(line: Column) -> Column:
    """Commands that a shell couldn't find. Most shells say so outright, before or after the name; others only say `not found` behind their own name.

    A name that is a number is the line that the shell was at.
    """
    told = _find(_before(line, ": command not found"), rf"(?:^|[:\s])({_NAME}+)$")
    last = F.when(F.trim(_after(line, ": command not found")) == "", told).otherwise("")
    parts = F.split(line, ": ")
    ends = F.transform(parts, lambda p, i: F.element_at(F.split(p, "/"), -1).isin(SHELLS) & ((i == 0) | F.contains(p, F.lit("/"))))
    rest = F.slice(parts, F.array_position(ends, True).cast("int") + 1, F.size(parts))
    rest = F.when(F.get(rest, F.lit(0)).rlike("^(line )?[0-9]+$"), F.slice(rest, 2, F.size(parts))).otherwise(rest)
    bare = F.when(F.array_contains(ends, True) & F.get(rest, F.lit(1)).startswith("not found"), _find(F.get(rest, F.lit(0)), f"^({_NAME}+)$")).otherwise("")
    number = lambda n: F.when(n.rlike("^[0-9]+$"), "").otherwise(F.coalesce(n, F.lit("")))
    return F.array(number(last), _leading(_after(line, "command not found: ")), bare)


def program(line: Column) -> Column:
    """Programs that a build asks for or can't start."""
    return F.array(_quoted(_after(line, "Is "), " installed"), _quoted(_after(line, "failed to find tool ")), _quoted(_after(line, "linker "), " not found"))


def prose(line: Column) -> Column:
    """Names that configure scripts, CMake and others say they couldn't find, in words that may mean anything else too."""
    could = F.coalesce(_after(line, "Could not find "), _after(line, "could not find "))
    able = F.coalesce(_after(line, "Unable to find "), _after(line, "unable to find "))
    return F.array(_find(could, rf"^([A-Za-z]{_NAME}{{2,}})\s*$"), _find(could, f"^[`']({_NAME}{{2,}})[`']"), _find(_after(line, "Could NOT find "), "^([A-Za-z0-9_+-]{2,})"), _find(able, f"^([A-Za-z]{_NAME}{{2,}})"))


def cargo(line: Column) -> Column:
    """Crates whose build script failed."""
    return F.array(_find(_after(line, "failed to run custom build command for `"), "^([^`]+)`"))


def absent(line: Column) -> Column:
    """Whether a line says that pkg-config itself is missing; a build that asks whether it is installed doesn't."""
    named = F.contains(line, F.lit("pkg")) & F.contains(line, F.lit("not found"))
    return F.contains(line, F.lit("pkg-config command could not be found")) | (named & F.arrays_overlap(shell(line), F.array(F.lit("pkg-config"), F.lit("pkgconf"))))


#: The readers, the kind of thing each names, its evidence (2 names it outright, 1 is prose, 0 only tells the crate), and what every line has that it takes anything from.
READERS = [
    (pkg_config, "pkg-config", 2, "pkg|No package|(?i:system library)"), (linker, "library", 2, "find"), (compiler, "header", 2, "No such file|file not found"), (shell, "program", 2, "not found"),
    (program, "program", 2, "Is |tool|linker"), (prose, "prose", 1, "find"), (cargo, "build-script", 0, "custom build command"),
]
#: Words of which every line that a reader may take anything from has one.
CUES = ["found", "find", "installed", "No such file", "required by crate", "custom build command", "exit status", "did not exit"]


def findings(line: Column) -> Column:
    """All that a line says is missing: an array of name, kind and weight."""
    # within a function of an array the readers are evaluated as they stand; generated code for all of them would be too long for a method
    return F.get(F.transform(F.array(line), _findings), F.lit(0))


def _findings(line: Column) -> Column:
    out = []
    for read, kind, weight, cue in READERS:
        named = F.when(line.rlike(cue), F.filter(read(line), lambda n: n != "")).otherwise(F.array().cast("array<string>"))
        out.append(F.arrays_zip(named.alias("name"), F.array_repeat(F.lit(kind), F.size(named)).alias("kind"), F.array_repeat(F.lit(weight), F.size(named)).alias("weight")))
    tool = F.when(absent(line), F.array(F.struct(F.lit("pkg-config").alias("name"), F.lit("absent").alias("kind"), F.lit(3).alias("weight"))))
    return F.concat(*out, F.coalesce(tool, F.array().cast("array<struct<name: string, kind: string, weight: int>>")))


def names_dependency(text: Column) -> Column:
    """Whether any line of a text names a header or a library that a compiler or linker couldn't find; looser wordings don't count."""
    return F.exists(F.split(text, "\n"), lambda t: F.exists(F.concat(linker(t), compiler(t)), lambda n: n != ""))
