"""Where pages come from: rendered rows, raw glyph tables, PDF files and labels."""
