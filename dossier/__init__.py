"""Personal data-export archives to typed tables and Markdown documents, on Spark."""

from dossier.functions.language import Detector
from dossier.plans.catalog import DOCUMENTS, SECTIONS
from dossier.plans.convert import convert
from dossier.plans.documents import document, documents, manifest
from dossier.plans.section import Document, Merge, Section, Style, extract

__all__ = [
    "DOCUMENTS",
    "SECTIONS",
    "Detector",
    "Document",
    "Merge",
    "Section",
    "Style",
    "convert",
    "document",
    "documents",
    "extract",
    "manifest",
]
