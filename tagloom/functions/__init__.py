"""Column functions: text in, text (or tags, spans, numbers) out; built-in expressions wherever one exists."""
