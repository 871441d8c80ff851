"""Renders a PDF to page-NNNN.png. Needs pypdfium2; runs in a process of its own."""

from __future__ import annotations

import argparse
import os


def dpi(value: str) -> int:
    number = int(value)
    if not 72 <= number <= 600:
        raise argparse.ArgumentTypeError("from 72 to 600")
    return number


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--dpi", type=dpi, default=300)
    options = parser.parse_args()
    import numpy as np
    import pypdfium2

    from foliospark.operators.raster import encode_png

    os.makedirs(options.output, exist_ok=True)
    document = pypdfium2.PdfDocument(options.input)
    if not len(document):
        raise SystemExit("no pages")
    for i in range(len(document)):
        image = np.asarray(document[i].render(scale=options.dpi / 72).to_numpy())[..., :3][..., ::-1]
        with open(os.path.join(options.output, f"page-{i + 1:04d}.png"), "wb") as file:
            file.write(encode_png(np.ascontiguousarray(image)))


if __name__ == "__main__":
    main()
