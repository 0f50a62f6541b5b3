"""Fixed schemas and dimensions: findings in report order, page classes, limit codes, region types."""

from __future__ import annotations

#: Fixed values: (code, description, can be located), in report order.
FINDINGS = [
    ("NO_TEXT_LAYER", "No native text glyphs were found; the page may be blank or image-only.", False),
    ("MISSING_UNICODE", "Some glyphs have no usable Unicode mapping.", True),
    ("REPLACEMENT_CHARACTERS", "Extracted text contains Unicode replacement characters.", True),
    ("TINY_TEXT", "Some text is below the configured size threshold and may be hidden or unreliable.", True),
    ("MALFORMED_TOUNICODE_CMAP", "A declared ToUnicode CMap could not be parsed reliably.", False),
    ("INVALID_TOUNICODE_CMAP", "A declared ToUnicode CMap contains no usable Unicode mappings.", False),
    ("IMPLICIT_COMPOSITE_UNICODE_MAPPING", "A composite font has no explicit ToUnicode map; extracted Unicode may be inferred rather than authored.", True),
    ("READING_ORDER_DIVERGENCE", "Content-stream and position-based extraction produce different character order.", False),
    ("SPARSE_TEXT_OVER_FULL_PAGE_IMAGE", "A near-full-page image has only a small extracted text layer; OCR may be incomplete.", False),
    ("PARTIAL_TEXT_OVER_FULL_PAGE_IMAGE", "Visible text occupies too little of a near-full-page image; the text layer may be partial.", False),
    ("RTL_TEXT_REQUIRES_EXTRACTION_PROFILE", "Right-to-left text requires a downstream extraction-order profile before direct routing.", True),
    ("ANNOTATION_MISSING_UNICODE", "Some annotation appearance glyphs have no usable Unicode mapping.", False),
    ("ANNOTATION_REPLACEMENT_CHARACTERS", "Annotation appearance text contains Unicode replacement characters.", False),
]
ORDINAL = {code: i for i, (code, _, _) in enumerate(FINDINGS)}
LOCATABLE = [code for code, _, located in FINDINGS if located]

REGION_TYPES = ["IMAGE", "ANNOTATION", "FORM_FIELD", "VECTOR_PATH"]
REGION_SAMPLES, LOCATION_SAMPLES = 32, 8

#: Work limits (code, label, default), in the order in which a document is worked through.
LIMITS = [
    ("GLYPH_COUNT", "glyph-count", 1_000_000),
    ("SEMANTIC_CHARACTER_COUNT", "semantic-character-count", 5_000_000),
    ("FONT_COUNT", "font-count", 10_000),
    ("IMAGE_COUNT", "image-count", 100_000),
    ("PAINTED_VECTOR_PATH_COUNT", "painted-vector-path-count", 1_000_000),
    ("ANNOTATION_COUNT", "annotation-count", 100_000),
    ("ANNOTATION_APPEARANCE_STREAM_COUNT", "annotation-appearance-stream-count", 100_000),
    ("OPTIONAL_CONTENT_REFERENCE_COUNT", "optional-content-reference-count", 100_000),
    ("DOCUMENT_SURFACE_COUNT", "document-surface-count", 100_000),
]

#: Key of a page.
PAGE = ["file_id", "page_number"]
