"""Files of code with what the chunkers make of them, row by row."""

JAVA = """package shop;

import java.util.List;

@Entity(name = "cart {")
public class Cart<T extends Item> implements Holder {
    private int total = compute(1);
    public Cart(int total) { this.total = total; }

    @Override
    public <U> Map<String, List<U>> group(@Nullable String key, int... sizes) throws IOException {
        if (key == null) { return null; }
        Runnable r = new Runnable() { public void run() { log("}"); } };
        return null;
    }

    abstract void checkout(int id);

    interface Listener { void changed(); default int weight() { return 1; } }

    enum Color { RED(1), BLUE(2) { int shade() { return 7; } }; Color(int code) { this.code = code; } }
}
"""

TYPESCRIPT = """import { a } from './a';

export function first<T>(items: T[]): T { return items[0]; }
export const load = async (url: string): Promise<void> => {
  await fetch(url);
};
const add = (a: number, b: number) => a + b;
type Handler = (event: string) => void;
type Box<T> = { value: T; open: () => void };

export interface Shape {
  area(): number;
}

export abstract class Circle<T> extends Base implements Shape {
  constructor(private radius: number) { super(); }
  private static async build<T>(value: T): Promise<{ value: T }> { return { value }; }
  get size(): number { return 1; }
  onClick = (e: Event) => { this.fire(e); };
  abstract area(): number;
}
"""

JAVASCRIPT = """function pick({ a, b }, options = {}) {
  return a + b;
}
const square = x => x * x;
const cube = function (x) { return x * x * x; };
module.exports = {
  parse(text) { return /[}"']/.test(text); },
  run: async () => { await pick({}); },
};
items.map(function (item) { return item.id; });
class Queue { push(item) { this.items.push(item); } *drain() { yield* this.items; } }
"""

LARGE_METHODS = 120
LARGE = "public class Large {\n" + "".join(f"  public int method{i}(int value) {{\n    return value + {i};\n  }}\n" for i in range(LARGE_METHODS)) + "}\n"

FILES = {"Cart.java": ("java", JAVA), "shapes.ts": ("typescript", TYPESCRIPT), "util.js": ("javascript", JAVASCRIPT), "Large.java": ("java", LARGE)}
