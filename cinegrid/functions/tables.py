"""Fixed values of the frame model: formats, codes and coefficients. All are facts that results depend on."""

# Leading bytes (hex) in the order in which they are tried; formats without an entry have no signature.
SIGNATURES = [
    ("jp2", ["0000000C6A5020200D0A870A", "FF4FFF51", "FF4F"]),
    ("png", ["89504E470D0A1A0A"]),
    ("jpeg", ["FFD8FF"]),
    ("gif", ["474946383761", "474946383961"]),
    ("webp", []),
    ("farbfeld", ["6661726266656C64"]),
    ("qoi", ["716F6966"]),
    ("dds", ["44445320"]),
    ("bmp", ["424D"]),
    ("exr", ["762F3101"]),
    ("tiff", ["49492A00", "4D4D002A", "49492B00", "4D4D002B"]),
    ("hdr", ["233F52414449414E4345", "233F52474245"]),
    ("pnm", []),
    ("jxl", ["0000000C4A584C200D0A870A", "FF0A"]),
]
AVIF_BRANDS = ["avif", "avis"]
HEIF_BRANDS = ["heic", "heix", "hevc", "hevx", "mif1", "msf1", "heim", "heis", "hevm", "hevs"]

# File name extensions of each format.
EXTENSIONS = {
    "avif": ["avif"], "bmp": ["bmp", "dib"], "dds": ["dds"], "exr": ["exr"], "farbfeld": ["ff", "farbfeld"], "gif": ["gif"],
    "heif": ["heic", "heif", "hif", "avci"], "hdr": ["hdr", "rgbe", "pic"], "ico": ["ico", "cur"], "jp2": ["jp2", "j2k", "jpc", "jpf", "jpx"],
    "jpeg": ["jpg", "jpeg", "jpe", "jfif"], "jxl": ["jxl"], "png": ["png", "apng"], "pnm": ["pbm", "pgm", "ppm", "pam", "pnm"], "qoi": ["qoi"],
    "tga": ["tga", "targa", "icb", "vda", "vst"], "tiff": ["tif", "tiff"], "webp": ["webp"],
}

# Header sizes of a bare bitmap, and bit depths for each compression code.
DIB_SIZES = [12, 40, 52, 56, 108, 124]
DIB_DEPTHS = {0: [1, 2, 4, 8, 16, 24, 32], 1: [8], 2: [4], 3: [16, 32]}

# Orientation code -> (transpose, flip x, flip y) in output space, and its inverse.
ORIENTATIONS = {1: (False, False, False), 2: (False, True, False), 3: (False, True, True), 4: (False, False, True), 5: (True, False, False), 6: (True, True, False), 7: (True, True, True), 8: (True, False, True)}
INVERSE_ORIENTATION = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 8, 7: 7, 8: 6}

# Colour codes that have a name (2 is "unspecified").
PRIMARIES = [1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 22]
TRANSFERS = [1, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16, 18]
MATRICES = [0, 1, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14]

# Luma coefficients (kr, kb) of the matrices that can be converted; 0 is the identity.
COEFFICIENTS = {1: (0.2126, 0.0722), 4: (0.30, 0.11), 5: (0.299, 0.114), 6: (0.299, 0.114), 7: (0.212, 0.087), 8: (0.25, 0.25), 9: (0.2627, 0.0593)}
MATRIX_CODES = [0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14]

# Where a chroma sample lies within its group, as a share of it, by code.
CHROMA_PHASES = {0: (0.0, 0.5), 1: (0.5, 0.5), 2: (0.0, 0.0), 3: (0.5, 0.0), 4: (0.0, 1.0), 5: (0.5, 1.0)}
