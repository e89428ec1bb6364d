"""Sky-model text, image headers and beam file names."""
