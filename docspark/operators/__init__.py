"""DataFrame operators over blocks, Markdown, chunks, images, charts and vectors."""
