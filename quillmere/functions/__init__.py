"""Column functions: text, stems, compound words, and the fixed values they use."""
