"""Parsers of sequence files over byte streams, and the rules for formats and codecs."""

from __future__ import annotations

import gzip
import io
import lzma
import struct
import zlib
import sys
from collections.abc import Iterable, Iterator

FORMATS = ("auto", "fasta", "fastq", "sam", "bam", "cram")
CODECS = ("auto", "none", "gz", "xz")
#: File extensions, after a codec's own.
EXTENSIONS = {".fa": "fasta", ".fasta": "fasta", ".fna": "fasta", ".fq": "fastq", ".fastq": "fastq", ".sam": "sam", ".bam": "bam", ".cram": "cram"}
Fields = tuple[str, str | None, str, str | None]


class SequenceError(ValueError):
    """A file that isn't what it should be."""


def codec_of(path: str, compression: str = "auto") -> str:
    if compression not in CODECS:
        raise ValueError(f"compression is one of {', '.join(CODECS)}")
    if compression != "auto":
        return compression
    return "gz" if path.endswith(".gz") else "xz" if path.endswith(".xz") else "none"


def format_by_name(path: str) -> str | None:
    for end in (".gz", ".xz"):
        path = path.removesuffix(end)
    return next((f for e, f in EXTENSIONS.items() if path.endswith(e)), None)


def open_bytes(path: str, compression: str = "auto") -> io.BufferedIOBase:
    """A file, or standard input for "-", without its compression (gzip members and xz streams may follow one another)."""
    codec = codec_of(path, compression)
    raw = sys.stdin.buffer if path == "-" else open(path, "rb", buffering=1 << 20)
    if codec == "gz":
        return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)
    return io.BufferedReader(lzma.LZMAFile(raw), 1 << 20) if codec == "xz" else raw


def detect(path: str, format: str = "auto", compression: str = "auto", records_only: bool = True) -> str:
    """The format: as given, else by extension, else by the first byte that isn't white space."""
    if format not in FORMATS:
        raise ValueError(f"format is one of {', '.join(FORMATS)}")
    found = format if format != "auto" else format_by_name(path)
    if found is None:
        with open_bytes(path, compression) as f:
            while (block := f.read(4096)) and not block.strip(b" \t\r\n\x0b\x0c"):
                pass
        first = block.lstrip(b" \t\r\n\x0b\x0c")[:1]
        found = {b">": "fasta", b"@": "fastq"}.get(first)
        if found is None:
            raise SequenceError(f"{path}: the format can't be told from the content")
    if records_only and found in ("sam", "bam", "cram"):
        raise SequenceError(f"{path}: {found} is supported by stats only")
    return found


def split_header(line: str) -> tuple[str, str | None]:
    """The id ends at the first blank or tab; what follows the run of them is the description."""
    cut = min((i for i in (line.find(" "), line.find("\t")) if i >= 0), default=-1)
    if cut < 0:
        return line, None
    return line[:cut], line[cut:].lstrip(" \t") or None


def _header(line: bytes, raw: bool) -> tuple[str, str | None]:
    try:
        text = line[1:].decode("utf-8")
    except UnicodeDecodeError:
        raise SequenceError(f"header isn't UTF-8: {line[:80]!r}") from None
    return (text, None) if raw else split_header(text)


def _first(lines: Iterator[bytes], marks: tuple[bytes, ...], where: str) -> bytes | None:
    for line in lines:
        line = line.rstrip(b"\r\n")
        if line:
            if line[:1] not in marks:
                raise SequenceError(f"{where}: a record begins with {line[:20]!r}")
            return line
    return None


def parse_fasta(lines: Iterable[bytes], raw: bool = False, where: str = "input") -> Iterator[Fields]:
    """> header, then the lines up to the next >, blank ones left out, put together."""
    lines = iter(lines)
    head = _first(lines, (b">",), where)
    parts: list[bytes] = []
    if head is None:
        return
    for line in lines:
        line = line.rstrip(b"\r\n")
        if line[:1] == b">":
            yield *_header(head, raw), b"".join(parts).decode("latin-1"), None
            head, parts = line, []
        elif line:
            parts.append(line)
    yield *_header(head, raw), b"".join(parts).decode("latin-1"), None


def parse_fastq(lines: Iterable[bytes], raw: bool = False, where: str = "input", strict: bool = False) -> Iterator[Fields]:
    """@ header, sequence lines up to one with +, then quality lines until they are as long as the sequence."""
    lines = iter(lines)
    while True:
        if strict:
            head = next(lines, b"").rstrip(b"\r\n")
            if not head:
                if any(x.strip(b"\r\n") for x in lines):
                    raise SequenceError(f"{where}: a blank line between records")
                return
            if head[:1] != b"@":
                raise SequenceError(f"{where}: a record begins with {head[:20]!r}")
        else:
            head = _first(lines, (b"@",), where)
            if head is None:
                return
        parts: list[bytes] = []
        plus = False
        for line in lines:
            line = line.rstrip(b"\r\n")
            if line[:1] == b"+":
                plus = True
                break
            if line[:1] == b">":
                raise SequenceError(f"{where}: a sequence line begins with >")
            parts.append(line)
        seq = b"".join(parts)
        if strict and (not plus or not parts):
            raise SequenceError(f"{where}: a record without sequence or + line")
        held: list[bytes] = []
        size = 0
        while plus and size < len(seq):
            line = next(lines, None)
            if line is None:
                break
            held.append(line.rstrip(b"\r\n"))
            size += len(held[-1])
        if size != len(seq):
            raise SequenceError(f"{where}: sequence of {len(seq)} and quality of {size} characters in {head[:80]!r}")
        yield *_header(head, raw), seq.decode("latin-1"), b"".join(held).decode("latin-1")


def _line_starts(f: io.BufferedIOBase, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin at or behind an offset."""
    f.seek(max(0, start - 1))
    at = start
    if start:
        at += len(f.readline()) - 1
    for line in f:
        yield at, line.rstrip(b"\r\n")
        at += len(line)


def parse_fasta_range(f: io.BufferedIOBase, start: int, stop: int, raw: bool = False, where: str = "input") -> Iterator[tuple[int, Fields]]:
    """(offset, record) of the records that begin in [start, stop), whatever their ends."""
    head, head_at = None, 0
    parts: list[bytes] = []
    for at, line in _line_starts(f, start):
        if line[:1] == b">":
            if head is not None:
                yield head_at, (*_header(head, raw), b"".join(parts).decode("latin-1"), None)
            if at >= stop:
                return
            head, head_at, parts = line, at, []
        elif head is not None:
            parts.append(line)
        elif line and not start:
            raise SequenceError(f"{where}: a record begins with {line[:20]!r}")
    if head is not None:
        yield head_at, (*_header(head, raw), b"".join(parts).decode("latin-1"), None)


def parse_fastq_range(f: io.BufferedIOBase, start: int, stop: int, raw: bool = False, where: str = "input") -> Iterator[tuple[int, Fields]]:
    """The same for records of four lines each.

    A record begins at a line with @ of which the next but one begins with +.  A quality line with @ can't be
    taken for it, since the next but one is then a sequence.
    """
    lines = _line_starts(f, start)
    held: list[tuple[int, bytes]] = []
    if start:
        for item in lines:
            held.append(item)
            if len(held) >= 3 and held[-3][1][:1] == b"@" and item[1][:1] == b"+":
                held = held[-3:]
                break
            if held[0][0] >= stop:
                return
            held = held[-2:]
        else:
            return
    while True:
        while len(held) < 4:
            item = next(lines, None)
            if item is None:
                if held and any(x for _, x in held):
                    raise SequenceError(f"{where}: the file ends inside a record, or records aren't on four lines")
                return
            if held or item[1]:
                held.append(item)
        (at, head), (_, seq), (_, plus), (_, qual) = held
        if at >= stop:
            return
        if head[:1] != b"@" or plus[:1] != b"+":
            raise SequenceError(f"{where}: records have to be on four lines to be read in ranges ({head[:20]!r})")
        if len(seq) != len(qual):
            raise SequenceError(f"{where}: sequence of {len(seq)} and quality of {len(qual)} characters in {head[:80]!r}")
        yield at, (*_header(head, raw), seq.decode("latin-1"), qual.decode("latin-1"))
        held = []


def parse_range(path: str, kind: str, start: int, stop: int, raw: bool = False) -> Iterator[tuple[int, Fields]]:
    with open(path, "rb", buffering=1 << 20) as f:
        yield from (parse_fasta_range if kind == "fasta" else parse_fastq_range)(f, start, stop, raw, path)


def parse_sam(lines: Iterable[bytes], where: str = "input") -> Iterator[Fields]:
    for line in lines:
        line = line.rstrip(b"\r\n")
        if not line or line[:1] == b"@":
            continue
        fields = line.split(b"\t")
        if len(fields) < 11:
            raise SequenceError(f"{where}: an alignment of {len(fields)} fields")
        seq = b"" if fields[9] == b"*" else fields[9]
        qual = None if fields[10] == b"*" else fields[10]
        if qual is not None and len(qual) != len(seq):
            raise SequenceError(f"{where}: sequence of {len(seq)} and quality of {len(qual)} characters")
        yield fields[0].decode("utf-8"), None, seq.decode("latin-1"), None if qual is None else qual.decode("latin-1")


#: The bases of BAM's four-bit codes.
_BASES = "=ACMGRSVTWYHKDBN"


def parse_bam(stream: io.BufferedIOBase, where: str = "input") -> Iterator[Fields]:
    """Alignments of a BAM stream without its BGZF blocks; qualities of 0xFF are missing, others get base 33."""

    def take(n: int) -> bytes:
        data = stream.read(n)
        if len(data) != n:
            raise SequenceError(f"{where}: the file ends inside a record")
        return data

    if take(4) != b"BAM\x01":
        raise SequenceError(f"{where}: not a BAM file")
    take(struct.unpack("<i", take(4))[0])
    for _ in range(struct.unpack("<i", take(4))[0]):
        take(struct.unpack("<i", take(4))[0] + 4)
    while size := stream.read(4):
        if len(size) != 4:
            raise SequenceError(f"{where}: the file ends inside a record")
        data = take(struct.unpack("<i", size)[0])
        name, cigar, n = data[8], struct.unpack_from("<H", data, 12)[0], struct.unpack_from("<i", data, 16)[0]
        at = 32 + name + 4 * cigar
        packed = data[at : at + (n + 1) // 2]
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n]
        qual = data[at + (n + 1) // 2 : at + (n + 1) // 2 + n]
        yield data[32 : 32 + name - 1].decode("utf-8"), None, seq, None if not n or qual[:1] == b"\xff" else bytes(min(q + 33, 255) for q in qual).decode("latin-1")


def _bgzf(data: bytes) -> bytes:
    """One block of BAM's blocked gzip; an empty one ends a file."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(out, records: Iterable[tuple[str, str, str | None]], block: int = 65_280) -> None:
    """Unmapped alignments of (id, seq, qual) as a BAM stream."""
    codes = {ord(c): i for i, c in enumerate(_BASES)}
    held = bytearray(b"BAM\x01" + struct.pack("<ii", 0, 0))
    for id_, seq, qual in records:
        name = id_.encode() + b"\0"
        bases = [codes.get(b, 15) for b in (seq or "").upper().encode("latin-1")]
        packed = bytes(a << 4 | b for a, b in zip(bases[::2], [*bases[1::2], 0], strict=False))
        quals = b"\xff" * len(bases) if qual is None else bytes(b - 33 for b in qual.encode("latin-1"))
        data = struct.pack("<iiBBHHHiiii", -1, -1, len(name), 255, 4680, 0, 4, len(bases), -1, -1, 0) + name + packed + quals
        held += struct.pack("<i", len(data)) + data
        while len(held) >= block:
            out.write(_bgzf(bytes(held[:block])))
            del held[:block]
    out.write(_bgzf(bytes(held)))
    out.write(_bgzf(b""))


def parse(path: str, format: str = "auto", compression: str = "auto", raw: bool = False, strict: bool = False, records_only: bool = True) -> Iterator[Fields]:
    """(id, desc, seq, qual) of each record of a file."""
    kind = detect(path, format, compression, records_only)
    if kind == "cram":
        raise SequenceError(f"{path}: CRAM needs a codec that isn't built in; convert it to BAM")
    with open_bytes(path, "gz" if kind == "bam" else compression) as f:
        if kind == "fasta":
            yield from parse_fasta(f, raw, path)
        elif kind == "fastq":
            yield from parse_fastq(f, raw, path, strict)
        elif kind == "sam":
            yield from parse_sam(f, path)
        else:
            yield from parse_bam(f, path)


def memory_size(text: str) -> int:
    """Bytes of 512M, 1g, 64k or a plain number; a bad number stands for the unit's default."""
    text = text.strip()
    unit, rest = text[-1:].upper(), text[:-1]
    scale = {"G": 1 << 30, "M": 1 << 20, "K": 1 << 10}
    default = {"G": 1, "M": 128, "K": 128}
    if unit in scale:
        return (int(rest) if rest.isdigit() else default[unit]) * scale[unit]
    return int(text) if text.isdigit() else 128 << 20
