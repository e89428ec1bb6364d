"""Column functions: complex numbers, coordinates, phases, spectra, shapes, Stokes."""
