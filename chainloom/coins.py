"""The supported coins. Adding one means adding an entry."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Coin:
    """`auxpow_from` is the header version from which blocks carry a merged-mining extension; None for never."""

    key: str
    name: str
    magic: int
    version_id: int
    genesis: str
    folder: str
    auxpow_from: int | None = None
    p2sh_version: int = 5


# Network constants of the coins.
COINS = {
    c.key: c
    for c in (
        Coin("bitcoin", "Bitcoin", 0xD9B4BEF9, 0x00, "000000000019d6689c085ae165831e934ff763ae46a2a6c172b3f1b60a8ce26f", ".bitcoin/blocks"),
        Coin("testnet3", "TestNet3", 0x0709110B, 0x6F, "000000000933ea01ad0ee984209779baaec3ced90fa3f408719526f8d77f4943", ".bitcoin/testnet3"),
        Coin("namecoin", "Namecoin", 0xFEB4BEF9, 0x34, "000000000062b72c5e2ceb45fbc8587e807c155b0da735e6483dfba2f0a9c770", ".namecoin", 0x10101),
        Coin("litecoin", "Litecoin", 0xDBB6C0FB, 0x30, "12a765e31ffd4059bada1e25190f6e98c99d9714d334efa41a195a7e7e04bfe2", ".litecoin/blocks"),
        Coin("dogecoin", "Dogecoin", 0xC0C0C0C0, 0x1E, "1a91e3dace36e2be3bf030a65679fe821aa1d6ef92e7c9902eb318182c355691", ".dogecoin/blocks", 0x620102),
        Coin("myriadcoin", "Myriadcoin", 0xEE7645AF, 0x32, "00000ffde4c020b5938441a0ea3d314bf619eff0b38f32f78f7583cffa1ea485", ".myriadcoin/blocks"),
        Coin("unobtanium", "Unobtanium", 0x03B5D503, 0x82, "000004c2fc5fffb810dccc197d603690099a68305232e552d96ccbe8e2c52b75", ".unobtanium/blocks"),
        Coin("noteblockchain", "NoteBlockchain", 0xE3EDE5F4, 0x35, "270f3e7b185c412d57ba913d10658df54f15201a67d736cb4071a4ec4eb54836", ".notecoin/blocks"),
    )
}


def coin(name: str = "bitcoin") -> Coin:
    """The coin of that key, in any letter case."""
    try:
        return COINS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown coin {name!r}; known: {', '.join(COINS)}") from None
