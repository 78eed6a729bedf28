"""Images and settings: reading pixels into rows, and writing rows as images, logs and settings."""
