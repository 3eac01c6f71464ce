"""What comes in and goes out: formats, files, chunks and dumps."""
