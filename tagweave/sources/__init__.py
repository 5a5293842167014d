"""Where markup comes from: any reader's column, files of text or bytes, crawl tables."""

from .files import html_files, html_streams
from .html import change_documents, node_table, parse_html, prefilter, spread

__all__ = ["change_documents", "html_files", "html_streams", "node_table", "parse_html", "prefilter", "spread"]
