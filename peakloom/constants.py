"""Physical constants, residue masses and default tolerances."""

from __future__ import annotations

# Masses in daltons.
PROTON = 1.007276466622
ELECTRON = 0.000548579909
H2O = 18.010564684
NH3 = 17.026549101
CO = 27.994914620
ISOTOPE_SPACING = 1.003355
C13_DOUBLE = 2.00671
S34_SPACING = 1.9957959

# Monoisotopic residue masses.
RESIDUES = {
    "A": 71.037114, "R": 156.101111, "N": 114.042927, "D": 115.026943, "C": 103.009185, "E": 129.042593, "Q": 128.058578,
    "G": 57.021464, "H": 137.058912, "I": 113.084064, "L": 113.084064, "K": 128.094963, "M": 131.040485, "F": 147.068414,
    "P": 97.052764, "S": 87.032028, "T": 101.047679, "W": 186.079313, "Y": 163.063320, "V": 99.068414,
}
STANDARD = "ACDEFGHIKLMNPQRSTVWY"
# Letters outside the twenty, and the residue whose mass they take.
SUBSTITUTES = {"X": "L", "Z": "Q", "B": "N", "J": "L", "U": "C", "O": "M"}
MASSES = RESIDUES | {k: RESIDUES[v] for k, v in SUBSTITUTES.items()}

# Mass shifts of modifications.
MODIFICATIONS = {"Carbamidomethyl": 57.021464, "Oxidation": 15.994915, "Acetyl": 42.010565, "Phospho": 79.966331, "Deamidation": 0.984016}

MS1_PPM, MS2_PPM, ISOTOPE_PPM = 10.0, 20.0, 5.0
#: Averagine: carbons per dalton times the share of 13C, as the isotope model uses them.
AVERAGINE = 0.5 / 12 * 0.011


def check() -> None:
    """Raises ValueError if a constant is outside its physical range."""
    ranges = {"PROTON": (1.0072, 1.0073), "H2O": (18.01, 18.02), "NH3": (17.02, 17.03), "ISOTOPE_SPACING": (1.003, 1.0034), "S34_SPACING": (1.99, 2.0)}
    bad = [name for name, (low, high) in ranges.items() if not low < globals()[name] < high]
    if bad or len(RESIDUES) != 20 or not all(57 < m < 187 for m in RESIDUES.values()):
        raise ValueError(f"constants out of range: {bad}")
