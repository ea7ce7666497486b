"""Kernels on page geometry: words to lines to blocks, and the order of blocks."""

from __future__ import annotations

from typing import Any

# Distances in points that results depend on.
SAME_LINE, PARAGRAPH_GAP, INDENT_GAP, INDENT_SHIFT = 3.0, 15.0, 8.0, 20
BLANK_WIDTH, LEFT_MARGIN, INDENT_WIDTH, MAX_BLANKS = 3.2, 36.0, 4.0, 8


def number(word: dict, *names: str) -> float:
    return float(next((word[n] for n in names if word.get(n) is not None), 0))


def inside(word: dict, boxes: list) -> bool:
    """Whether the centre of a word lies in a box; borders count."""
    x, y = (number(word, "x0") + number(word, "x1")) / 2, (number(word, "top") + number(word, "bottom")) / 2
    return any(b[0] <= x <= b[2] and b[1] <= y <= b[3] for b in boxes)


def union(boxes: list) -> list[float]:
    return [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)]


def lines_of_words(words: list[dict]) -> list[tuple[str, list[float]]]:
    """Lines with their boxes: a word joins while its top is near the mean top of the line so far."""
    lines: list[list[dict]] = []
    for word in sorted(words, key=lambda w: (number(w, "top"), number(w, "x0"))):
        tops = [number(w, "top") for w in lines[-1]] if lines else []
        if tops and abs(number(word, "top") - sum(tops) / len(tops)) <= SAME_LINE:
            lines[-1].append(word)
        else:
            lines.append([word])
    out = []
    for line in lines:
        line.sort(key=lambda w: number(w, "x0"))
        text = str(line[0].get("text", ""))
        for left, right in zip(line, line[1:]):
            gap = max(0.0, number(right, "x0") - number(left, "x1", "x0"))
            text += " " * max(1, min(MAX_BLANKS, round(gap / BLANK_WIDTH))) + str(right.get("text", ""))
        box = union([[number(w, "x0"), number(w, "top"), number(w, "x1", "x0"), number(w, "bottom", "top")] for w in line])
        out.append((" " * max(0, round((box[0] - LEFT_MARGIN) / INDENT_WIDTH)) + text.rstrip(), box))
    return out


def prose_blocks(words: list[dict]) -> list[tuple[str, list[float]]]:
    """Blocks of lines: a wide gap parts them, or a narrower one with a new indent."""
    groups: list[list[tuple[str, list[float]]]] = []
    for line in lines_of_words(words):
        last = groups[-1][-1][1] if groups else None
        gap = line[1][1] - last[3] if last else 0
        if not last or gap > PARAGRAPH_GAP or (gap > INDENT_GAP and abs(line[1][0] - last[0]) > INDENT_SHIFT):
            groups.append([])
        groups[-1].append(line)
    return [("\n".join(t for t, _ in g), union([b for _, b in g])) for g in groups]


def page_blocks(page: dict[str, Any]) -> list[dict[str, Any]]:
    """Blocks of a page given as blocks, as words and tables, or as text, in reading order."""
    from folioquery.operators.tables import cleaned_rows, table_markdown

    blocks: list[dict[str, Any]] = []
    if page.get("blocks"):
        for b in page["blocks"]:
            rows, header = cleaned_rows(b.get("table_rows")), list(b.get("table_header") or [])
            text = b.get("text") or b.get("raw_text") or table_markdown([header, *(b.get("table_rows") or [])])
            blocks.append({"block_type": b.get("block_type") or "prose", "raw_text": text, "bbox": b.get("bbox"), "table_header": header, "table_rows": rows})
    elif page.get("words") or page.get("tables"):
        boxes = []
        for t in page.get("tables") or []:
            rows = cleaned_rows(t.get("rows"))
            if t.get("bbox"):
                boxes.append(t["bbox"])
            if rows:
                blocks.append({"block_type": "table", "raw_text": table_markdown(rows), "bbox": t.get("bbox"), "table_header": rows[0], "table_rows": rows[1:]})
        words = [w for w in page.get("words") or [] if not inside(w, boxes)]
        blocks += [{"block_type": "prose", "raw_text": t, "bbox": b} for t, b in prose_blocks(words)]
    elif page.get("text"):
        blocks.append({"block_type": "prose", "raw_text": page["text"], "bbox": None})
    blocks.sort(key=lambda b: (round(b["bbox"][1], 2), round(b["bbox"][0], 2)) if b["bbox"] else (0, 0))
    for order, b in enumerate(blocks):
        b["block_order"] = order
        b["table_id"] = f"p{page['pdf_page']}-t{order}" if b["block_type"] == "table" else None
    return blocks


def content_types(pages: list[tuple[int, str]]) -> list[str]:
    """body, front_matter or navigation for pages (number, text) in order; indexes and contents run on over pages."""
    import re

    out, contents, index = [], False, False
    for number_, text in pages:
        low = text.lower()
        begins = bool(re.search(r"(?mi)^\s*index\s*$", text))
        lettered = re.search(r"(?m)^\s*\(A\)\s+", text)
        rules = re.search(r"(?m)^\s*\([a-z]+\)\s+", text) or re.search(r"\b(?:must|shall|regulations governing)\b", low)
        index = begins or (index and not (lettered and rules))
        versions = len(re.findall(r"(?m)^.*\b\d+\.\d+\b.*?\b(?:19|20)\d{2}-\d{2}-\d{2}\b", text))
        early = number_ <= 4
        if index:
            out.append("navigation")
        elif ("version number" in low and "issue date" in low) or (early and (versions >= 3 or "version control sheet" in low)):
            out.append("front_matter")
        else:
            contents = contents or "table of contents" in low
            contents = contents and (number_ <= 12 or len(re.findall(r"(?m)\.{4,}\s*\d+\s*$", text)) >= 2)
            out.append("navigation" if contents else "body")
    return out
