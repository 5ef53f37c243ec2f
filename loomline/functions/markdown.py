"""Markdown as safe HTML: CommonMark blocks and inline marks, then only listed tags, attributes and link schemes stay.

Blocks: ATX and setext headings, paragraphs, quotes, ordered and bullet lists, fenced and indented code, breaks, raw HTML, link
definitions. Inline: code, emphasis by the rules of delimiter runs, links, images, autolinks, hard breaks, escapes,
entities and raw tags. Containers nested deeper than ``MAX_DEPTH`` are shown as text.
"""

from __future__ import annotations

import html
import re
import string
import unicodedata
from html.parser import HTMLParser

# Tags that stay in sanitised HTML, and schemes that stay in links.
SAFE_TAGS = ["p", "br", "strong", "em", "b", "i", "ul", "ol", "li", "h1", "h2", "h3", "a", "blockquote", "code", "pre", "hr"]
SAFE_SCHEMES = ["http", "https", "mailto", "tel", "sms", "ftp", "ftps", "ssh", "news", "irc", "ircs", "xmpp", "sip", "geo", "webcal", "magnet"]
MAX_DEPTH = 40

_EMPTY_TAGS = {"br", "hr"}
_MUTED = {"script", "style"}
_SCHEME = re.compile(r"\s*([a-z][a-z0-9+.-]*):", re.I)


class Sanitiser(HTMLParser):
    """Rebuilds HTML from listed tags only, each closed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.muted = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _MUTED:
            self.muted += 1
        elif tag == "a":
            href = next((v for k, v in attrs if k == "href" and v is not None), None)
            title = next((v for k, v in attrs if k == "title" and v is not None), None)
            scheme = _SCHEME.match(re.sub(r"[\x00-\x20]", "", href or ""))
            if href is not None and scheme and scheme.group(1).lower() not in SAFE_SCHEMES:
                href = None
            kept = [f' {k}="{html.escape(v)}"' for k, v in (("href", href), ("title", title)) if v is not None]
            self.out.append(f'<a{"".join(kept)} rel="noopener noreferrer">')
            self.open.append(tag)
        elif tag in SAFE_TAGS:
            start = next((v for k, v in attrs if tag == "ol" and k == "start" and (v or "").isdigit()), None)
            self.out.append(f'<{tag} start="{start}">' if start else f"<{tag}>")
            if tag not in _EMPTY_TAGS:
                self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _MUTED:
            self.muted = max(0, self.muted - 1)
        elif tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.out.append(html.escape(data, quote=False))

    def result(self, source: str) -> str:
        self.feed(source)
        self.close()
        return "".join(self.out + [f"</{t}>" for t in reversed(self.open)])


_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*\Z")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*\Z)|~{3,})[^\n]*\Z")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*\Z")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})[.)])(?:( {1,4})(?=[^ \t])|( )(?= {4}[^ ])|[ \t]*\Z)")
# Tags that begin a block of raw HTML wherever they begin a line.
BLOCK_TAGS = "address article aside body blockquote caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu nav ol optgroup option p param pre script search section style summary table tbody td textarea tfoot th thead title tr track ul"
_RAW = re.compile(rf" {{0,3}}<(?:/?(?:{BLOCK_TAGS.replace(' ', '|')})(?=[\s/>]|\Z)|!--|\?|![a-z])", re.I)
_LONE_TAG = re.compile(r" {0,3}</?[a-z][a-z0-9-]*(?:\s+[a-z_:][\w.:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>[ \t]*\Z", re.I)
_DEFINITION = re.compile(r' {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(<[^<>]*>|\S+)(?:[ \t]+("[^"]*"|\'[^\']*\'|\([^()]*\)))?[ \t]*\Z')


def _label(text: str) -> str:
    return " ".join(text.casefold().split())


def _starts_block(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    if _ATX.match(line) or _BREAK.match(line) or _FENCE.match(line) or _QUOTE.match(line) or _RAW.match(line):
        return True
    m = _ITEM.match(line)
    return bool(m) and m.end() < len(line.rstrip()) and m.group(3) in (None, "1")


class Document:
    def __init__(self) -> None:
        self.links: dict[str, tuple[str, str | None]] = {}

    def collect(self, lines: list[str]) -> list[str]:
        """The lines without link definitions that stand by themselves outside fences."""
        out, fence, before_blank = [], "", True
        for x in lines:
            m = _FENCE.match(x)
            if fence:
                fence = "" if m and m.group(2).startswith(fence) and not x.strip().strip(fence[0]) else fence
            elif m:
                fence = m.group(2)
            elif before_blank and (d := _DEFINITION.match(x)):
                self.links.setdefault(_label(d.group(1)), (d.group(2).strip("<>"), d.group(3) and d.group(3)[1:-1]))
                continue
            before_blank = not x.strip()
            out.append(x)
        return out

    def blocks(self, lines: list[str], depth: int = 0) -> str:
        return "\n".join(x for _, x in self.parts(lines, depth))

    def parts(self, lines: list[str], depth: int = 0, tight: bool = False) -> list[tuple[bool, str]]:
        """The blocks of some lines, each with whether it is a paragraph; those of tight lists have no tags."""
        out, i, n = [], 0, len(lines)
        while i < n:
            x = lines[i]
            if not x.strip():
                i += 1
            elif x.startswith("    "):
                j = i
                while j < n and (lines[j].startswith("    ") or not lines[j].strip()):
                    j += 1
                code = "\n".join(y[4:] for y in lines[i:j]).strip("\n")
                out.append((False, f"<pre><code>{html.escape(code, quote=False)}\n</code></pre>"))
                i = j
            elif m := _FENCE.match(x):
                j, mark = i + 1, m.group(2)
                while j < n and not re.match(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*\Z", lines[j]):
                    j += 1
                indent = len(m.group(1))
                code = "".join(re.sub(rf"\A {{0,{indent}}}", "", y) + "\n" for y in lines[i + 1 : j])
                out.append((False, f"<pre><code>{html.escape(code, quote=False)}</code></pre>"))
                i = j + 1
            elif m := _ATX.match(x):
                k = len(m.group(1))
                out.append((False, f"<h{k}>{self.inline((m.group(2) or '').strip())}</h{k}>"))
                i += 1
            elif _BREAK.match(x):
                out.append((False, "<hr>"))
                i += 1
            elif _QUOTE.match(x) and depth < MAX_DEPTH:
                j, inner = i, []
                while j < n and lines[j].strip() and (_QUOTE.match(lines[j]) or (inner and inner[-1].strip() and not _starts_block(lines[j]))):
                    inner.append(_QUOTE.sub("", lines[j], count=1))
                    j += 1
                out.append((False, f"<blockquote>\n{self.blocks(inner, depth + 1)}\n</blockquote>"))
                i = j
            elif _ITEM.match(x) and depth < MAX_DEPTH:
                made, i = self.list_at(lines, i, depth)
                out.append((False, made))
            elif _RAW.match(x) or _LONE_TAG.match(x):
                j = i
                while j < n and lines[j].strip():
                    j += 1
                out.append((False, "\n".join(lines[i:j])))
                i = j
            else:
                j = i + 1
                while j < n and lines[j].strip() and not _SETEXT.match(lines[j]) and not _starts_block(lines[j]):
                    j += 1
                body = self.inline("\n".join(y.lstrip() for y in lines[i:j]).rstrip())
                if j < n and (m := _SETEXT.match(lines[j])):
                    k = 1 if m.group(1)[0] == "=" else 2
                    out.append((False, f"<h{k}>{body}</h{k}>"))
                    j += 1
                else:
                    out.append((True, body if tight else f"<p>{body}</p>"))
                i = j
        return out

    def list_at(self, lines: list[str], i: int, depth: int) -> tuple[str, int]:
        first = _ITEM.match(lines[i])
        kind, n = first.group(2)[-1], len(lines)
        items, loose = [], False
        while i < n and (m := _ITEM.match(lines[i])) and m.group(2)[-1] == kind and not _BREAK.match(lines[i]):
            width = len(m.group(1)) + len(m.group(2)) + len(m.group(4) or m.group(5) or " ")
            own, j = [lines[i][width:]], i + 1
            while j < n:
                y = lines[j]
                if not y.strip():
                    if not own[-1].strip() and len(own) == 1:
                        break  # an item can begin with one blank line at most
                    own.append("")
                elif y.startswith(" " * width):
                    own.append(y[width:])
                elif own[-1].strip() and not _starts_block(y) and not _ITEM.match(y):
                    own.append(y.lstrip())  # a paragraph goes on without its indent
                else:
                    break
                j += 1
            blank_after = 0
            while own and not own[-1].strip():
                own.pop()
                blank_after += 1
            more = j < n and (m2 := _ITEM.match(lines[j])) is not None and m2.group(2)[-1] == kind
            loose |= (blank_after > 0 and more) or self._gap(own)
            items.append(own)
            i = j
        made = "\n".join(self.item(own, depth + 1, not loose) for own in items)
        if first.group(3) is None:
            return f"<ul>\n{made}\n</ul>", i
        start = int(first.group(3))
        return f'<ol{"" if start == 1 else f" start=\"{start}\""}>\n{made}\n</ol>', i

    def item(self, own: list[str], depth: int, tight: bool) -> str:
        parts = self.parts(own, depth, tight)
        first, last = ("" if not parts or (tight and parts[k][0]) else "\n" for k in (0, -1))
        return f"<li>{first}{'\n'.join(x for _, x in parts)}{last}</li>"

    @staticmethod
    def _gap(own: list[str]) -> bool:
        """Whether a blank line stands between an item's own blocks, outside fences and nested lists."""
        fence = False
        for a, b in zip(own, own[1:]):
            fence ^= bool(_FENCE.match(a))
            if not a.strip() and b.strip() and not fence and not b.startswith(" "):
                return True
        return False

    _SPAN = re.compile(
        r"\\(?P<escape>[!-/:-@\[-`{-~])|(?P<hard>(?: {2,}|\\)\n)|(?P<ticks>`+)|<(?P<auto>[a-z][a-z0-9+.-]{1,31}:[^\s<>]*)>|<(?P<mail>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>"
        r"|(?P<tag></?[a-z][a-z0-9-]*(?:\s+[a-z_:][\w.:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|<!--.*?-->)"
        r"|(?P<entity>&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,31});)|(?P<run>\*+|_+)|(?P<image>!\[)|(?P<open>\[)|(?P<close>\])",
        re.I | re.S,
    )
    _TARGET = re.compile(r"""\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""", re.S)
    _REFERENCE = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]", re.S)

    def inline(self, text: str) -> str:
        """HTML of the inline marks of one block."""
        nodes: list[str] = []
        runs: list[dict] = []  # of emphasis: node, mark, length, whether it can open and close
        brackets: list[tuple[int, int, bool, int]] = []  # node, place behind it in the text, image, runs below it
        at, n = 0, len(text)
        ticks: dict[int, list[int]] = {}
        for m in re.finditer(r"`+", text):
            ticks.setdefault(len(m.group()), []).append(m.start())
        add = lambda s: nodes.append(html.escape(s, quote=False))
        while at < n:
            m = self._SPAN.search(text, at)
            if m is None:
                add(text[at:])
                break
            add(text[at : m.start()])
            at = m.end()
            if m["escape"]:
                add(m["escape"])
            elif m["hard"]:
                nodes.append("<br>\n")
            elif m["ticks"]:
                size = len(m["ticks"])
                ends = ticks[size]
                while ends and ends[0] < at:
                    ends.pop(0)
                if not ends:
                    add(m["ticks"])
                    continue
                code = text[at : ends[0]].replace("\n", " ")
                if code.strip() and code[0] == code[-1] == " ":
                    code = code[1:-1]
                nodes.append(f"<code>{html.escape(code, quote=False)}</code>")
                at = ends[0] + size
            elif m["auto"] or m["mail"]:
                link = m["auto"] or f"mailto:{m['mail']}"
                nodes.append(f'<a href="{html.escape(link)}">{html.escape(m["auto"] or m["mail"], quote=False)}</a>')
            elif m["tag"]:
                nodes.append(m["tag"])
            elif m["entity"]:
                add(html.unescape(m["entity"]))
            elif m["run"]:
                before, after = text[m.start() - 1 : m.start()] or " ", text[at : at + 1] or " "
                space = lambda c: c.isspace()
                punct = lambda c: c in string.punctuation or unicodedata.category(c)[0] in "PS"
                left = not space(after) and (not punct(after) or space(before) or punct(before))
                right = not space(before) and (not punct(before) or space(after) or punct(after))
                under = m["run"][0] == "_"
                runs.append({"node": len(nodes), "mark": m["run"][0], "size": len(m["run"]), "whole": len(m["run"]), "opens": left and (not under or not right or punct(before)), "closes": right and (not under or not left or punct(after))})
                nodes.append(m["run"])
            elif m["image"] or m["open"]:
                brackets.append((len(nodes), at, bool(m["image"]), len(runs)))
                add(m["image"] or "[")
            else:
                at = self._close(text, at, nodes, runs, brackets)
        self._emphasis(nodes, runs)
        return "".join(nodes)

    def _close(self, text: str, at: int, nodes: list[str], runs: list[dict], brackets: list) -> int:
        """A closing bracket: a link or image if its text and target fit, else a plain bracket."""
        if not brackets:
            nodes.append("]")
            return at
        node, begins, image, below = brackets.pop()
        inner = text[begins : at - 1]
        plain = lambda s: html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", s))
        if m := self._TARGET.match(text, at):
            target, title, end = plain(m.group(1) if m.group(1) is not None else m.group(2)), m.group(3) and plain(m.group(3)[1:-1]), m.end()
        else:
            m = self._REFERENCE.match(text, at)
            found = self.links.get(_label(m.group(1) if m and m.group(1).strip() else inner)) if self.links else None
            if found is None:
                nodes.append("]")
                return at
            target, title, end = plain(found[0]), found[1], m.end() if m else at
        inside = runs[below:]
        del runs[below:]
        self._emphasis(nodes, inside)
        if image:
            nodes[node:] = [""]  # pictures aren't shown
            return end
        nodes[node] = f'<a href="{html.escape(target)}"' + (f' title="{html.escape(title)}"' if title else "") + ">"
        nodes.append("</a>")
        brackets[:] = [b for b in brackets if b[2]]  # links hold no links
        return end

    @staticmethod
    def _emphasis(nodes: list[str], runs: list[dict]) -> None:
        """Pair the runs of marks, the nearest fitting opener for each closer."""
        before = {r["node"]: "" for r in runs}
        after = dict(before)
        stack: list[dict] = []
        for r in runs:
            while r["closes"] and r["size"]:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k]["mark"] == r["mark"] and not ((stack[k]["closes"] or r["opens"]) and (stack[k]["whole"] + r["whole"]) % 3 == 0 and (stack[k]["whole"] % 3 or r["whole"] % 3))), None)
                if k is None:
                    break
                opener, size = stack[k], 2 if stack[k]["size"] >= 2 and r["size"] >= 2 else 1
                tag = "strong" if size == 2 else "em"
                after[opener["node"]] = f"<{tag}>" + after[opener["node"]]
                before[r["node"]] += f"</{tag}>"
                opener["size"] -= size
                r["size"] -= size
                del stack[k + 1 :]
                if not opener["size"]:
                    stack.pop()
            if r["opens"] and r["size"]:
                stack.append(r)
        for r in runs:
            nodes[r["node"]] = before[r["node"]] + r["mark"] * r["size"] + after[r["node"]]


def markdown_to_html(text: str) -> str:
    """E31 on one text."""
    doc = Document()
    lines = [x.expandtabs(4) for x in re.split(r"\r\n|\r|\n", text.replace("\0", "\ufffd"))]
    made = doc.blocks(doc.collect(lines))
    return Sanitiser().result(made + "\n" if made else "")
