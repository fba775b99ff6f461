"""Output scripts: pattern, address and embedded text.

The Bitcoin networks are read by template; other coins by their stack of data and opcodes. Every pattern that can be told from
the hex text alone also exists as a Spark expression (`classify`), which keeps whole-stage code generation.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.functions.codec import dsha

# Names of the patterns.
OP_RETURN = "OpReturn"
UNSPENDABLE = "Unspendable"
P2PK = "Pay2PublicKey"
P2PKH = "Pay2PublicKeyHash"
P2SH = "Pay2ScriptHash"
P2WPKH = "Pay2WitnessPublicKeyHash"
P2WSH = "Pay2WitnessScriptHash"
P2TR = "Pay2Taproot"
WITNESS = "WitnessProgram"
MULTISIG = "Pay2MultiSig"
UNKNOWN = "NotRecognised"
# Fixed value: why a script can't be taken apart.
PUSH_ERROR = "Unexpected EOF"

# Opcodes that end a legacy script at once, other than OP_RETURN: reserved, disabled and unassigned ones.
DEAD = [0x50, 0x62, 0x65, 0x66, 0x7E, 0x7F, 0x80, 0x81, 0x83, 0x84, 0x85, 0x86, 0x89, 0x8A, 0x8D, 0x8E, 0x95, 0x96, 0x97, 0x98, 0x99, *range(0xBA, 0x100)]
NO_OPS = {0x61, *range(0xB0, 0xBA)}

BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


#: All pairs of base-58 digits, so that two come off a number at a time.
_PAIRS = [a + b for a in BASE58 for b in BASE58]


def base58(data: bytes) -> str:
    n, out = int.from_bytes(data, "big"), []
    while n:
        n, r = divmod(n, 3364)
        out.append(_PAIRS[r])
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + "".join(reversed(out)).lstrip("1")


def base58check(version: int, payload: bytes) -> str:
    body = bytes([version]) + payload
    return base58(body + dsha(body)[:4])


def hash160(data: bytes) -> bytes:
    return hashlib.new("ripemd160", hashlib.sha256(data).digest()).digest()


def _steps() -> list[int]:
    """What each of the 32 leading digits adds to the checksum of a Bech32 address."""
    generators = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)  # fixed values
    out = [0] * 32
    for top in range(32):
        for i, g in enumerate(generators):
            out[top] ^= g if top >> i & 1 else 0
    return out


_STEPS = _steps()


def _polymod(values: list[int], chk: int = 1) -> int:
    for v in values:
        chk = (chk & 0x1FFFFFF) << 5 ^ v ^ _STEPS[chk >> 25]
    return chk


def segwit_address(prefix: str, version: int, program: bytes) -> str:
    """Bech32 address of a version 0 program, bech32m of any later one."""
    size = -(-8 * len(program) // 5)
    bits = int.from_bytes(program, "big") << 5 * size - 8 * len(program)
    words = [version, *[bits >> 5 * k & 31 for k in range(size - 1, -1, -1)]]
    spread = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    check = _polymod([*words, *[0] * 6], _polymod(spread)) ^ (0x2BC830A3 if version else 1)
    return prefix + "1" + "".join([BECH32[w] for w in words] + [BECH32[check >> 5 * (5 - i) & 31] for i in range(6)])


def pushes(script: bytes, literal: bool = False):
    """The stack of a script: bytes for pushed data, int for an opcode other than a push. ValueError at a push beyond the end.

    `literal` reads the length of the three PUSHDATA forms from the opcode byte on, as some older parsers do.
    """
    at, out = 0, []
    while at < len(script):
        op = script[at]
        at += 1
        if op == 0 or op > 0x4E:
            out.append(op)
            continue
        size = op
        if op > 0x4B:
            width = 1 << (op - 0x4C)
            if at - literal + width > len(script):
                raise ValueError(PUSH_ERROR)
            size = int.from_bytes(script[at - literal : at - literal + width], "little")
            at += width
        if at + size > len(script):
            raise ValueError(PUSH_ERROR)
        out.append(script[at : at + size] if size else op)
        at += size
    return out


def _number(op) -> int | None:
    """1 to 16 for the opcodes that push these numbers."""
    return op - 0x50 if isinstance(op, int) and 0x51 <= op <= 0x60 else None


def _is_multisig(script: bytes) -> bool:
    try:
        s = [b"" if x == 0 else x for x in pushes(script)]
    except ValueError:
        return False
    if len(s) < 3 or s[-1] != 0xAE or _number(s[0]) is None or _number(s[-2]) is None:
        return False
    keys = s[1:-2]
    return all(isinstance(k, bytes) for k in keys) and _number(s[-2]) == len(keys) >= _number(s[0])


def evaluate_bitcoin(script: bytes, version_id: int = 0) -> tuple[str | None, str, str | None]:
    """(address, pattern, OP_RETURN text) on Bitcoin (version 0x00) or its test network (0x6f).

    The text is what follows the first two bytes, empty where that is no UTF-8. A bare public key has the address of its hash.
    """
    main = version_id == 0
    prefix, keys, hashes = ("bc", 0x00, 0x05) if main else ("tb", 0x6F, 0xC4)
    n = len(script)
    if n and script[0] == 0x6A:
        try:
            return None, OP_RETURN, script[2:].decode()
        except UnicodeDecodeError:
            return None, OP_RETURN, ""
    if n and script[0] in DEAD:
        return None, UNSPENDABLE, None
    if n in (35, 67) and script[0] == n - 2 and script[-1] == 0xAC:
        return base58check(keys, hash160(script[1:-1])), P2PK, None
    if n == 25 and script[:3] == b"\x76\xa9\x14" and script[-2:] == b"\x88\xac":
        return base58check(keys, script[3:23]), P2PKH, None
    if n == 23 and script[:2] == b"\xa9\x14" and script[-1] == 0x87:
        return base58check(hashes, script[2:22]), P2SH, None
    if 4 <= n <= 42 and (script[0] == 0 or 0x51 <= script[0] <= 0x60) and script[1] == n - 2:
        version = script[0] and script[0] - 0x50
        pattern = {(0, 22): P2WPKH, (0, 34): P2WSH, (1, 34): P2TR}.get((version, n), WITNESS)
        valid = version or n in (22, 34)  # a version 0 program of another length has no address
        return segwit_address(prefix, version, script[2:]) if valid else None, pattern, None
    return None, MULTISIG if _is_multisig(script) else UNKNOWN, None


def evaluate_other(script: bytes, version_id: int, p2sh_version: int = 5, literal: bool = False) -> tuple[str | None, str, str | None]:
    """(address, pattern, OP_RETURN text) on other coins: by shape of the stack, opcodes without effect left out.

    Invalid UTF-8 in a text becomes U+FFFD. A push beyond the end makes the script NotRecognised.
    """
    try:
        stack = [x for x in pushes(script, literal) if x not in NO_OPS]
    except ValueError:
        return None, UNKNOWN, None
    shape = tuple("data" if isinstance(x, bytes) else x for x in stack)
    if shape == (0x76, 0xA9, "data", 0x88, 0xAC):
        return base58check(version_id, stack[2]), P2PKH, None
    if shape == ("data", 0xAC):
        return base58check(version_id, hash160(stack[0])), P2PK, None
    if shape == (0xA9, "data", 0x87):
        return base58check(p2sh_version, stack[1]), P2SH, None
    if shape == (0x6A, "data"):
        return None, OP_RETURN, stack[1].decode("utf-8", "replace")
    if shape == (0x52, "data", "data", "data", 0x53, 0xAE):
        return None, MULTISIG, None
    return None, UNKNOWN, None


def evaluate(script: bytes | None, version_id: int = 0, literal: bool = False, p2sh_version: int = 5) -> tuple[str | None, str | None, str | None]:
    """(address, pattern, OP_RETURN text) of a script; all null for a null script. The last two arguments are those of evaluate_other."""
    if script is None:
        return None, None, None
    return evaluate_bitcoin(script, version_id) if version_id in (0, 0x6F) else evaluate_other(script, version_id, p2sh_version, literal)


def script_error(script: bytes | None, version_id: int = 0, literal: bool = False) -> str | None:
    """Why a script can't be taken apart, as text; null where it can. Its pattern is NotRecognised then."""
    if script is None or version_id in (0, 0x6F):  # Bitcoin's scripts are read by template
        return None
    try:
        pushes(script, literal)
    except ValueError as e:
        return f"ScriptError: {e}"
    return None


def evaluated(script: Column, version_id: Column | None = None, literal: bool = False, p2sh_version: int = 5) -> Column:
    """Struct (address, pattern, op_return_data) of a script column, by Arrow batches; equal scripts of a batch are read once."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("address", "pattern", "op_return_data")])

    @F.pandas_udf(schema)
    def run(scripts: pd.Series, versions: pd.Series) -> pd.DataFrame:
        seen: dict = {}
        out = []
        for s, v in zip(scripts, versions):
            k = (None if s is None else bytes(s), int(v))
            if k not in seen:
                seen[k] = evaluate(*k, literal, p2sh_version)
            out.append(seen[k])
        return pd.DataFrame(out, columns=["address", "pattern", "op_return_data"])

    return run(script, F.lit(0) if version_id is None else version_id)


def classify(script: Column) -> Column:
    """The Bitcoin pattern of a script as an expression. Multisig keys have 33 or 65 bytes here; `evaluated` takes any."""
    h = F.lower(F.hex(script))
    dead = "|".join(f"{b:02x}" for b in DEAD)
    key = "(?:21[0-9a-f]{66}|41[0-9a-f]{130})"
    counts = "|".join(f"(?:{'|'.join(f'{m:02x}' for m in range(0x51, 0x51 + n))}){key}{{{n}}}{0x50 + n:02x}" for n in range(1, 17))
    witness = "|".join(f"{n:02x}[0-9a-f]{{{2 * n}}}" for n in range(2, 41))
    rules = [
        (OP_RETURN, "^6a"),
        (UNSPENDABLE, f"^(?:{dead})"),
        (P2PK, f"^{key}ac$"),
        (P2PKH, "^76a914[0-9a-f]{40}88ac$"),
        (P2SH, "^a914[0-9a-f]{40}87$"),
        (P2WPKH, "^0014[0-9a-f]{40}$"),
        (P2WSH, "^0020[0-9a-f]{64}$"),
        (P2TR, "^5120[0-9a-f]{64}$"),
        (WITNESS, f"^(?:00|5[1-9a-f]|60)(?:{witness})$"),
        (MULTISIG, f"^(?:{counts})ae$"),
    ]

    def first_rule(x: Column) -> Column:
        named = F.when(x.isNull(), F.lit(None).cast("string"))
        for name, rule in rules:
            named = named.when(x.rlike(rule), F.lit(name))
        return named.otherwise(F.lit(UNKNOWN))

    return F.get(F.transform(F.array(h), first_rule), 0)  # the hex text is bound once


def op_return_text(script: Column) -> Column:
    """The text of a Bitcoin OP_RETURN script: all behind the second byte, empty where that is no UTF-8."""
    return F.coalesce(F.try_validate_utf8(F.substring(script, 3, 1 << 30).cast("string")), F.lit(""))
