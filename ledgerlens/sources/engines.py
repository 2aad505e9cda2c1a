"""Engines that turn a file's bytes into pages, for `files.read_pages`. Their libraries are optional: an engine needs its own only when it runs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

# How a page is made ready for recognition, and how it is recognised.
DPI, CONTRAST, THRESHOLD, TESSERACT, LANGUAGE = 250, 2.0, 140, "--oem 3 --psm 6", "eng"


def plain_engine(content: bytes) -> Iterator[dict]:
    """Pages of plain text set apart by form feeds, as text extractors write them."""
    for page in content.decode("utf-8", "replace").split("\f"):
        yield {"text": page}


def mupdf_engine(content: bytes) -> Iterator[dict]:
    """PDF pages by PyMuPDF: blocks from top to bottom on landscape pages, blank ones left out, and plain text elsewhere."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            box = page.rect
            if box.width > box.height:
                ordered = sorted(page.get_text("blocks"), key=lambda b: (b[1], b[0]))
                text = "\n".join(b[4] for b in ordered if b[4].strip())
            else:
                text = page.get_text()
            yield {"text": text, "width": box.width, "height": box.height}


def plumber_engine(content: bytes) -> Iterator[dict]:
    """PDF pages by pdfplumber, with their tables; a page whose tables can't be read has none."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as doc:
        for page in doc.pages:
            try:
                tables = page.extract_tables()
            except Exception:  # a broken table must not cost the page its text
                tables = []
            yield {"text": page.extract_text() or "", "width": float(page.width), "height": float(page.height), "tables": tables}


def ocr_engine(content: bytes) -> Iterator[dict]:
    """Scanned PDF pages: drawn, turned grey, sharpened, set to black and white, and recognised by Tesseract. Its pages join the others as column `ocr` of the triage."""
    import fitz
    import pytesseract
    from PIL import Image, ImageEnhance, ImageFilter

    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            drawn = page.get_pixmap(dpi=DPI)
            grey = Image.frombytes("RGB", (drawn.width, drawn.height), drawn.samples).convert("L").filter(ImageFilter.SHARPEN)
            bare = ImageEnhance.Contrast(grey).enhance(CONTRAST).point(lambda v: 255 if v > THRESHOLD else 0)
            yield {"text": pytesseract.image_to_string(bare, lang=LANGUAGE, config=TESSERACT), "width": page.rect.width, "height": page.rect.height}


def pdf_of_pages(content: bytes, pages: Iterable[int]) -> bytes:
    """A PDF file of the chosen pages (numbers from 0), in order."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc, fitz.open() as out:
        for n in sorted(set(pages)):
            out.insert_pdf(doc, from_page=n, to_page=n)
        return out.tobytes()
